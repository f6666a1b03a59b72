"""Tool-call linking for chat data, with DataFrame expressions only.

Calls and results are joined by (conversation, call id). Calls are put in topological order by levels: a call
without open dependencies has level 0, any other one more than the highest of those it names. A conversation's calls are
settled level by level within one row, or by joins if they are too many for that; what is left when nothing more can be
settled lies on or behind a cycle.
Arguments are parsed as variants and checked against the schema of their tool; links come out as canonical JSON,
compact and with sorted keys.

Defined results: arguments that are null, empty or no JSON object are invalid (``not an object``); an unknown or null
tool is invalid; a call without a result has a null result, a result without a call is left out of the links and
counted by ``orphans``; of repeated calls or results with one id the first by turn counts, then the smaller text; calls
with a null id or conversation can't be linked and have level 0; a dependency that is no call of the conversation
is ``missing`` and does not hold the call back. Columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What a JSON type of a schema accepts, as type names of variants.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}

#: Calls of a conversation that are put in order within one row.
ROW_CALLS = 1_000

#: tool -> argument -> (type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments, as an array of texts; empty if nothing is."""
    v = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    out = F.when(~is_object, F.array(F.lit("not an object")))
    given = F.json_object_keys(arguments)
    for tool, schema in schemas.items():
        checks = [F.transform(F.array_sort(F.array_except(given, F.array(*[F.lit(a) for a in schema]) if schema else F.array().cast("array<string>"))), lambda a: F.concat(F.lit("unknown "), a))]
        for argument, (kind, required) in sorted(schema.items()):
            path = f"$['{argument}']"
            found = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
            wrong = F.lit(True)
            for t in TYPES[kind]:
                wrong = wrong & ~found.startswith(t)
            has = F.array_contains(given, argument)
            checks.append(F.when(~has, F.array(F.lit(f"missing {argument}")) if required else F.array().cast("array<string>")).when(F.coalesce(wrong, F.lit(True)), F.array(F.lit(f"{argument} is no {kind}"))).otherwise(F.array().cast("array<string>")))
        out = out.when(name == tool, F.concat(*checks))
    return out.otherwise(F.array(F.lit("unknown tool")))


def canonical(arguments: Column) -> Column:
    """Compact JSON with sorted keys; null if it is none."""
    return F.to_json(F.try_parse_json(arguments))


def _first(rows: DataFrame, *columns: str) -> DataFrame:
    """One row of each (conv_id, call_id): combined before it is shuffled."""
    return rows.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(*columns)).alias("_r")).select("conv_id", "call_id", *[F.col(f"_r.{c}").alias(c) for c in columns])


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    """``levels`` by joins, a level a round for all conversations at once."""
    ids = calls.select("conv_id", "call_id")
    wanted = calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.filter(F.coalesce("depends_on", F.array().cast("array<string>")), lambda d: d.isNotNull()))).alias("needs"))
    exists = ids.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    edges = cut(wanted.join(exists, ["conv_id", "needs"], "left"))
    missing = edges.where("there is null").groupBy("conv_id", "call_id").agg(F.count("*").alias("missing"))
    open_ = cut(edges.where("there").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("needs")).alias("needs")))
    done = cut(ids.join(open_, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    settled, level = done, 0
    while not open_.isEmpty():
        fresh = settled.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("now"))
        left = open_.select("conv_id", "call_id", F.explode("needs").alias("need")).join(fresh, ["conv_id", "need"], "left")
        state = cut(left.groupBy("conv_id", "call_id").agg(F.collect_set(F.when(F.col("now").isNull(), F.col("need"))).alias("needs")))
        level += 1
        settled = cut(state.where(F.size("needs") == 0).select("conv_id", "call_id", F.lit(level).alias("level")))
        open_ = state.where(F.size("needs") > 0)
        if settled.isEmpty():
            break
        done = done.union(settled)
    return ids.join(done, ["conv_id", "call_id"], "left").join(missing, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "level", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))


def _levels_in_rows(calls: DataFrame) -> DataFrame:
    """``levels`` within a row for each conversation: calls name each other by position, and an array of levels is filled level by level until none is added."""
    none = F.array().cast("array<string>")
    needs = F.array_distinct(F.filter(F.coalesce("depends_on", none), lambda d: d.isNotNull())).alias("needs")
    rows = calls.select("conv_id", "call_id", needs).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("call_id", "needs"))).alias("calls"))
    rows = rows.select("conv_id", "calls", F.transform("calls", lambda c: c["call_id"]).alias("ids"))
    places = F.transform("calls", lambda c: F.filter(F.transform(c["needs"], lambda d: F.array_position(F.col("ids"), d).cast("int")), lambda i: i > 0))
    missing = F.transform("calls", lambda c: F.size(F.filter(c["needs"], lambda d: ~F.array_contains(F.col("ids"), d))).cast("long"))
    rows = rows.select("conv_id", "ids", places.alias("at"), missing.alias("missing"))
    state = lambda at, level, more: F.struct(at.alias("at"), level.alias("level"), more.alias("more"))

    def settle(s: Column, r: Column) -> Column:
        level = F.transform(s["level"], lambda v, i: F.when(v >= 0, v).when(F.forall(F.element_at(s["at"], i + 1), lambda j: F.element_at(s["level"], j) >= 0), r).otherwise(-1))
        return F.when(s["more"], F.element_at(F.transform(F.array(level), lambda x: state(s["at"], x, F.array_contains(x, r))), 1)).otherwise(s)

    rounds = F.when(F.size("at") > 1, F.sequence(F.lit(1), F.size("at") - 1)).otherwise(F.array().cast("array<int>"))
    level = F.aggregate(rounds, state(F.col("at"), F.transform("at", lambda a: F.when(F.size(a) == 0, 0).otherwise(-1)), F.lit(True)), settle, lambda s: s["level"])
    out = rows.select("conv_id", F.explode(F.arrays_zip("ids", level.alias("level"), "missing")).alias("r"))
    return out.select("conv_id", F.col("r.ids").alias("call_id"), F.when(F.col("r.level") >= 0, F.col("r.level")).alias("level"), F.col("r.missing").alias("missing"))


def levels(calls: DataFrame, row_calls: int = ROW_CALLS) -> DataFrame:
    """(conv_id, call_id, level, missing) of distinct ``calls`` (conv_id, call_id, depends_on array<string>); level is null on and behind a cycle.

    Conversations of up to ``row_calls`` calls are a row each; larger ones are settled by joins, in as many rounds as they have levels."""
    large = cut(calls.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > row_calls).select("conv_id"))
    if large.isEmpty():
        return _levels_in_rows(calls)
    return _levels_in_rows(calls.join(large, "conv_id", "left_anti")).union(_levels_by_rounds(cut(calls.join(large, "conv_id", "left_semi"))))


def serialised(linked: DataFrame) -> DataFrame:
    """(conv_id, json) of the rows of ``link``: a conversation's calls in topological order, as one array of canonical JSON; what has no level (a cycle) comes last."""
    place = F.struct(F.col("level").isNull().alias("cyclic"), "level", "turn", "call_id", "json")
    ordered = F.transform(F.array_sort(F.collect_list(place)), lambda x: x["json"])
    return linked.where("conv_id is not null").groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("json"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """A row a call: conv_id, call_id, turn, name, level, missing, result_turn, valid, problems and json.

    ``calls`` has conv_id, call_id, turn, name, arguments (JSON) and depends_on; ``results`` has conv_id, call_id, turn
    and content. Within a conversation (level, turn, call_id) is a topological order."""
    call = cut(_first(calls.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))), "turn", "name", "arguments", "depends_on"))
    result = _first(results, "turn", "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    wrong = problems(F.col("name"), F.col("arguments"), schemas)
    linked = call.join(result, ["conv_id", "call_id"], "left").join(levels(call), ["conv_id", "call_id"])
    loose = calls.where("conv_id is null or call_id is null").select("conv_id", "call_id", "turn", "name", "arguments", "depends_on", F.lit(None).cast("int").alias("result_turn"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("missing"))
    every = linked.unionByName(loose).withColumn("problems", F.explode(F.array(wrong)))
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        F.lit(',"id":'), _quoted("call_id"), F.lit(',"name":'), _quoted("name"), F.lit(',"result":'), _quoted("content"), F.lit("}"),
    )
    return every.select("conv_id", "call_id", "turn", "name", "level", "missing", "result_turn", (F.size("problems") == 0).alias("valid"), F.array_join("problems", "; ").alias("problems"), body.alias("json"))


def _quoted(column: str) -> Column:
    """A string as JSON, null as null."""
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(F.col(column).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results without a call, by conversation."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("n_orphans"))


# --- Calls and results that the registered query derives from plain conversations ---------------------------

SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "translate": {"text": ("string", True), "strict": ("boolean", False)},
    "measure": {"words": ("number", True)},
}


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results): each assistant turn is a call whose arguments come from its text and which needs the call of half its turn, if odd; each user turn after the first is the result of the turn before it."""
    text = F.coalesce("text", F.lit(""))
    lead = F.regexp_extract(text, r"^\s*(\S+)", 1)
    n = F.size(F.array_remove(F.split(F.regexp_replace(text, r"\s", " "), " "), ""))
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    half = F.floor(F.col("turn") / 2).cast("long")
    kind = F.pmod(F.col("turn"), F.lit(8))
    arguments = (
        F.when(kind == 1, F.to_json(F.struct(lead.alias("query"), n.alias("limit"))))
        .when(kind == 3, F.to_json(F.struct(lead.alias("text"), (n > 20).alias("strict"))))
        .when(kind == 5, F.to_json(F.struct(n.alias("words"))))
        .otherwise(F.to_json(F.struct(n.cast("string").alias("limit"), lead.alias("query"))))
    )
    tool = F.when(kind == 3, "translate").when(kind == 5, "measure").otherwise("search")
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").cast("int").alias("turn"), tool.alias("name"), arguments.alias("arguments"),
        F.when(half % 2 == 1, F.array(name(half))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = conversations.where("role = 'user' and turn > 0").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").cast("int").alias("turn"), F.col("text").alias("content"))
    return calls, results
