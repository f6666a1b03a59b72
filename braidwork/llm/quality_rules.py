"""Learned decision lists over text statistics, with DataFrame expressions only.

``text_statistics`` adds the statistics of a text in its own row, without a shuffle. ``learn_rules`` is
sequential covering: grow a conjunction of thresholds by gain on two thirds of the labelled rows, prune
it to the prefix that is most precise on the rest, take what it covers away, and go on. ``verdict`` turns
the ordered rules into one CASE expression.

Defined results: a null or empty text has no words, so it fails the base rules; a null doc_id is scored
like any other row but never learnt from; repeated rows each get their own result; without labels no rule
is learnt and only the base rules decide. Other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, paired, word_array

SYMBOLS = r"[#*$%&|<>]"
#: Words in a window; a power of two, as windows are hashed by doubling.
WINDOW = 8
FEATURES = ("n_words", "word_length", "symbols_per_word", "upper_share", "dup_line_share", "repeat_share", "richness", "stop_share")
STATISTICS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES)
#: Frequent function words of the four languages.
STOP_WORDS = ("the of and to in is was that it as on for with by this are be or from at an a "
              "de la que el en y los las un una por con no del se es al lo "
              "le les des et du une dans est pour qui sur pas au ce avec "
              "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als").split()  # fmt: skip


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """Reject what meets all conditions. precision and covered are those of the pruning rows."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the FEATURES. Counts are exact for texts of any length; windows are told apart by 64-bit hashes."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = F.col("_sorted")
    same = lambda k, other: at[k]["h"] == at[other]["h"]
    last = F.size("_sorted") - 1
    repeated = F.filter(
        F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(k, F.greatest(k - 1, F.lit(0)))).otherwise(False) | F.when(k < last, same(k, F.least(k + 1, last))).otherwise(False)
    )
    starts = F.sort_array(F.transform(repeated, lambda k: at[k]["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["end"])).alias("n"), x.alias("end")),
        lambda a: a["n"],
    )
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words")).otherwise(F.lit(0.0))
    per_char = lambda c: F.when(F.col("word_chars") > 0, c / F.col("word_chars")).otherwise(F.lit(0.0))
    stop = [F.xxhash64(F.lit(w)) for w in dict.fromkeys(STOP_WORDS)]
    return (
        docs.withColumn("_words", word_array(F.col(text)))
        .withColumn("_hashed", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_windows", paired(F.col("_hashed"), 1))
        .withColumn("_windows", paired(F.col("_windows"), 2))
        .withColumn("_windows", paired(F.col("_windows"), 4))
        .withColumn("_lines", lines)
        .withColumn(
            "_sorted",
            F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered).cast("long"),
                "_n_lines": F.size("_lines"),
                "_n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
                "_n_distinct": F.size(F.array_distinct("_hashed")),
                "_n_stop": F.size(F.filter("_hashed", lambda h: h.isin(stop))),
            }
        )
        .withColumns(
            {
                "word_length": per_word(F.col("word_chars")),
                "symbols_per_word": per_word(F.col("n_symbols")),
                "upper_share": per_char(F.col("_n_upper")),
                "dup_line_share": F.when(F.col("_n_lines") > 0, F.col("n_dup_lines") / F.col("_n_lines")).otherwise(F.lit(0.0)),
                "repeat_share": per_word(F.col("n_repeat_words")),
                "richness": F.when(F.col("n_words") > 0, F.log1p("_n_distinct") / F.log1p("n_words")).otherwise(F.lit(1.0)),
                "stop_share": per_word(F.col("_n_stop")),
            }
        )
        # A filter on the result stops at the generator; through projections it would take copies of all these expressions along.
        .select(*docs.columns, F.explode(F.array(F.struct(*STATISTICS))).alias("_stats"))
        .select(*docs.columns, "_stats.*")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_fit_rows: int = 20_000, n_cuts: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.97, min_covered: int = 5) -> list[Rule]:
    """Rules that find ``label`` 0. ``docs`` has doc_id and text.

    Rows that fail the base rules are left out, as those rules come first. Learns from at most about ``max_fit_rows`` labelled rows, those whose hashed doc_id comes first: that
    bounds what is broadcast to reach their texts, and nothing else. The rows themselves stay in Spark;
    only counts by (feature, bin) reach the driver."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    n = marked.count()
    if n > max_fit_rows:
        marked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(max_fit_rows * 1e6 / n))
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = text_statistics(docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))).where(~base_failed())
    rows = cut(rows.select("doc_id", "_y", *[F.col(f).cast("double").alias(f) for f in FEATURES]))
    shares = [i / n_cuts for i in range(n_cuts + 1)]
    got = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    seen = {f: sorted(set(got[f] or [])) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in seen.items()}  # between the values seen, not at one of them

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c < F.col(f))) if cuts[f] else F.lit(0)

    bins = F.array(*[bin_of(f) for f in FEATURES])
    rows = cut(rows.select((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("held"), (F.col("_y") == 0).alias("bad"), bins.alias("bins")))

    def holds(conds: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, j in conds:
            out = out & ((F.col("bins")[f] > j) if above else (F.col("bins")[f] <= j))
        return out

    def counts(conds: list[tuple[int, bool, int]], done: list[list[tuple[int, bool, int]]]) -> dict[bool, list[dict[int, list[int]]]]:
        left = rows.where(holds(conds))
        for d in done:
            left = left.where(~holds(d))
        out = {h: [{} for _ in FEATURES] for h in (False, True)}
        for r in left.select("held", "bad", F.posexplode("bins").alias("f", "bin")).groupBy("held", "bad", "f", "bin").count().collect():
            out[r["held"]][r["f"]].setdefault(r["bin"], [0, 0])[int(r["bad"])] += r["count"]
        return out

    def total(stats: list[dict[int, list[int]]]) -> tuple[int, int]:
        return sum(g for g, _ in stats[0].values()), sum(b for _, b in stats[0].values())

    rules: list[Rule] = []
    done: list[list[tuple[int, bool, int]]] = []
    while len(rules) < max_rules:
        conds: list[tuple[int, bool, int]] = []
        best: tuple[float, int, int] | None = None
        stats = counts(conds, done)
        while True:
            good, bad = total(stats[False])
            if not bad:
                break
            held_good, held_bad = total(stats[True])
            if conds and held_bad:
                score = (held_bad + 1) / (held_bad + held_good + 2)
                if best is None or score > best[0] + 1e-9:
                    best = (score, len(conds), held_good + held_bad)
            if len(conds) == max_conditions or (conds and good == 0):
                break
            was = math.log2(bad / (good + bad))
            gain, pick = 0.0, None
            for f, name in enumerate(FEATURES):
                seen_good = seen_bad = 0
                for j in range(len(cuts[name])):
                    g, b = stats[False][f].get(j, (0, 0))
                    seen_good, seen_bad = seen_good + g, seen_bad + b
                    for above, gg, bb in ((False, seen_good, seen_bad), (True, good - seen_good, bad - seen_bad)):
                        if bb and bb < bad + (good > gg) and (x := bb * (math.log2(bb / (gg + bb)) - was)) > gain + 1e-9:
                            gain, pick = x, (f, above, j)
            if pick is None:
                break
            conds.append(pick)
            stats = counts(conds, done)
        if best is None or best[2] < min_covered:
            break
        kept = conds[: best[1]]
        if (best[0] * (best[2] + 2) - 1) / best[2] < min_precision:
            break
        done.append(kept)
        rules.append(Rule(tuple(Condition(FEATURES[f], above, cuts[FEATURES[f]][j]) for f, above, j in kept), (best[0] * (best[2] + 2) - 1) / best[2], best[2]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True: kept. Base failures first, then the rules in order."""
    out = F.when(base_failed(), F.lit(False))
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def rule_number(rules: list[Rule]) -> Column:
    """0-based number of the rule that rejects a row, null if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, r in enumerate(rules):
        out = out.when(r.column(), F.lit(i))
    return out.otherwise(F.lit(None).cast("int"))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the number of the rule, for every row."""
    return text_statistics(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(rules).alias("kept"), rule_number(rules).alias("rule")
    )


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    return text_statistics(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), "_text").where(verdict(rules)).select("_row.*")
