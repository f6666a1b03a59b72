"""Parquet tables, and the chat, search and metering views that are derived from them by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return messages_of(table(spark, d, "conversations"))


def messages_of(c: DataFrame) -> DataFrame:
    """Of the turns of conversations, from a table or a stream."""
    root = F.col("conv_id") * 1000 + 1
    plain = (F.col("turn") == 0) | (F.col("turn") % 3 == 2)
    hidden = F.col("turn") == 6
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    at = base + F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=(F.col("turn") * (1 + F.col("conv_id") % 50)).cast("int"))
    rows = c.select(
        (F.col("conv_id") % 5).alias("siteid"), F.col("conv_id").alias("sid"), (root + F.col("turn")).alias("id"), (root + F.col("turn")).alias("smsgid"),
        F.when(plain | hidden, F.lit(0).cast("long")).otherwise(root).alias("commentvia"),
        F.when(F.col("turn").isin(4, 7), root).otherwise(F.lit(0).cast("long")).alias("sharemsgid"),
        F.when(plain, 0).when(hidden, 60).otherwise(20).alias("msgtype"), F.col("text").alias("message"),
        F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3).cast("long").alias("archiveid"),
        F.when(F.col("conv_id") % 3 == 0, 2).otherwise(1).alias("role"), at.alias("messagetime"),
    )
    return rows.withColumns({"isdeleted": F.col("smsgid") % 17 == 0, "editedon": F.when(F.col("smsgid") % 11 == 0, F.col("messagetime") + F.expr("INTERVAL '5' MINUTE"))})


def streams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct().select("id", (F.col("id") % 7).cast("int").alias("teamstreamtype"), (F.col("id") % 23 == 0).alias("isdeleted"))


def members(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sid")).distinct()
    return c.select(
        "sid", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("archiveid"), (F.col("sid") % 19 == 0).alias("isdeleted"),
        F.when(F.col("sid") % 9 == 0, 20).when(F.col("sid") % 13 == 0, None).otherwise(1).alias("mode_of_join"), (F.col("sid") * 1000 + 2).alias("lastreadsmsgid"),
    )


def persons(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "acme[V]agent_dana", 1, "Dana", "Fox"), (2, "acme_robin", 1, "", "")]
    # A fixed dimension of two rows; the tables it is joined to are the data.
    return spark.createDataFrame(rows, "im_archiveid long, username string, siteid int, firstname string, lastname string").withColumn("isdeleted", F.lit(False))


CHANNELS = {0: "dm", 1: "display_channel", 2: "private_channel", 3: "company_channel", 4: "public_channel", 5: "temporary_channel"}


def channel_type(code):  # noqa: ANN001, ANN201
    """Stream type code to channel type; other codes and null give null."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in CHANNELS.items():
        out = out.when(code == k, F.lit(v))
    return out


def search_docs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("message_id"), (i % 5).alias("site_id"), (i % 40).alias("sid"), channel_type(i % 7).alias("channel_type"), (i % 11).alias("author_archive_id"),
        (i - i % 4).alias("thread_root_id"), "text", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=((i * 37) % 40320).cast("int"))).alias("created_at"),
        (i % 29 == 0).alias("is_deleted"), (i % 4 != 0).alias("is_thread_reply"),
    )


def stored_summaries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("start_date")).agg(F.min("event_id").alias("id"), F.count("*").alias("n"))
    return e.select("id", F.col("user_id").alias("ref_id"), "start_date", (F.col("start_date") + F.make_dt_interval(days=(1 + F.col("id") % 4).cast("int"))).alias("end_date"), "n")


def usage(spark: SparkSession, d: str) -> DataFrame:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    tokens = F.col("l_quantity").cast("long") * 1000
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        "l_orderkey", "l_linenumber", (F.col("o_custkey") % 7).alias("siteid"), (F.col("l_linenumber") % 4).alias("model_no"), F.col("o_orderpriority").alias("operation"),
        tokens.alias("input_tokens"), F.floor(tokens * F.round("l_discount", 2)).cast("long").alias("cached_tokens"), (F.col("l_quantity").cast("long") * 100).alias("output_tokens"),
    )


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """The non-empty lines of documents as blocks of a canonical document."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    n = F.length("text")
    kind = F.when(F.col("text").rlike(r"^(•|-|\*|[0-9][.)])"), "list_item").when(F.col("ordinal") == 0, "title").when(n < 40, "heading").when(F.col("text").contains(" | "), "table").otherwise("paragraph")
    return lines.where(F.trim("text") != "").select(
        "doc_id", "ordinal", "text", kind.alias("type"), F.when(F.col("ordinal") % 13 != 12, (F.floor(F.col("ordinal") / 5) + 1).cast("int")).alias("page_number"), (8 + (n % 5) * 2).alias("font_size"),
        F.when(kind == "table", F.size(F.split("text", r" \| "))).alias("n_columns"),
    )


#: The same views for the oracle, as common table expressions.
CTE = {
    "messages": """messages AS (SELECT *, smsgid % 17 = 0 AS isdeleted, CASE WHEN smsgid % 11 = 0 THEN messagetime + INTERVAL 5 MINUTE END AS editedon FROM (
        SELECT conv_id % 5 AS siteid, conv_id AS sid, conv_id * 1000 + turn + 1 AS id, conv_id * 1000 + turn + 1 AS smsgid,
        CASE WHEN turn = 0 OR turn % 3 = 2 OR turn = 6 THEN 0 ELSE conv_id * 1000 + 1 END AS commentvia, CASE WHEN turn IN (4, 7) THEN conv_id * 1000 + 1 ELSE 0 END AS sharemsgid,
        CASE WHEN turn = 0 OR turn % 3 = 2 THEN 0 WHEN turn = 6 THEN 60 ELSE 20 END AS msgtype, text AS message, CAST(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS BIGINT) AS archiveid,
        CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS role, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn * (1 + conv_id % 50)) AS messagetime FROM conversations))""",
    "streams": "streams AS (SELECT DISTINCT conv_id AS id, conv_id % 7 AS teamstreamtype, conv_id % 23 = 0 AS isdeleted FROM conversations)",
    "members": """members AS (SELECT sid, a AS archiveid, sid % 19 = 0 AS isdeleted, CASE WHEN sid % 9 = 0 THEN 20 WHEN sid % 13 = 0 THEN NULL ELSE 1 END AS mode_of_join, sid * 1000 + 2 AS lastreadsmsgid
        FROM (SELECT DISTINCT conv_id AS sid FROM conversations) CROSS JOIN (VALUES (1), (2), (3)) v(a))""",
    "persons": "persons AS (SELECT * FROM (VALUES (1, 'acme[V]agent_dana', 1, 'Dana', 'Fox', FALSE), (2, 'acme_robin', 1, '', '', FALSE)) v(im_archiveid, username, siteid, firstname, lastname, isdeleted))",
    "search_docs": """search_docs AS (SELECT doc_id AS message_id, doc_id % 5 AS site_id, doc_id % 40 AS sid,
        CASE doc_id % 7 WHEN 0 THEN 'dm' WHEN 1 THEN 'display_channel' WHEN 2 THEN 'private_channel' WHEN 3 THEN 'company_channel' WHEN 4 THEN 'public_channel' WHEN 5 THEN 'temporary_channel' END AS channel_type,
        doc_id % 11 AS author_archive_id, doc_id - doc_id % 4 AS thread_root_id, text, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37) % 40320) AS created_at, doc_id % 29 = 0 AS is_deleted, doc_id % 4 <> 0 AS is_thread_reply FROM documents)""",
    "stored_summaries": """stored_summaries AS (SELECT id, ref_id, start_date, start_date + to_days(CAST(1 + id % 4 AS INTEGER)) AS end_date, n FROM (
        SELECT min(event_id) AS id, user_id AS ref_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start_date, count(*) AS n FROM events GROUP BY ALL))""",
    "usage_rows": """usage_rows AS (SELECT l_orderkey, l_linenumber, o_custkey % 7 AS siteid, l_linenumber % 4 AS model_no, o_orderpriority AS operation, CAST(l_quantity AS BIGINT) * 1000 AS input_tokens,
        CAST(floor(CAST(l_quantity AS BIGINT) * 1000 * round(l_discount, 2)) AS BIGINT) AS cached_tokens, CAST(l_quantity AS BIGINT) * 100 AS output_tokens FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "blocks": r"""blocks AS (SELECT *, CASE WHEN type = 'table' THEN len(string_split(text, ' | ')) END AS n_columns FROM (SELECT doc_id, ordinal, text,
        CASE WHEN regexp_matches(text, '^(•|-|\*|[0-9][.)])') THEN 'list_item' WHEN ordinal = 0 THEN 'title' WHEN length(text) < 40 THEN 'heading' WHEN contains(text, ' | ') THEN 'table' ELSE 'paragraph' END AS type,
        CASE WHEN ordinal % 13 <> 12 THEN CAST(floor(ordinal / 5) AS INTEGER) + 1 END AS page_number, 8 + (length(text) % 5) * 2 AS font_size
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM documents) WHERE trim(text) <> ''))""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with those views in front; ``sql`` may begin with further ones after a comma."""
    return "WITH " + ", ".join(CTE[n] for n in names) + " " + sql
