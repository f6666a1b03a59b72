"""Queries of document extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import text as x
from braidwork.operators import extraction as e
from braidwork.sources import tables as t

from .registry import Registry

Q = Registry()
Q.add(
    "paragraph_blocks", lambda s, d: t.table(s, d, "documents").select("doc_id", F.posexplode(x.paragraphs(F.replace("text", F.lit(".\n"), F.lit(".\r\n\r\n")))).alias("ordinal", "text")),
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS p FROM documents)
      SELECT doc_id, unnest(range(len(p))) AS ordinal, unnest(p) AS text FROM p""",
)


def _csv_cells(s: SparkSession, d: str) -> DataFrame:
    """Customers' orders as CSV files, one a customer, parsed back to cells."""
    rows = t.table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v")))).alias("r"))
    body = F.array_join(F.transform("r", lambda z: F.concat(F.lpad(z["k"].cast("string"), 12, "0"), F.lit(","), z["v"])), "\n")
    files = rows.select(F.col("o_custkey").alias("file_id"), F.lit("csv").alias("extension"), F.encode(F.concat(F.lit("key,priority\n"), body, F.lit("\n")), "UTF-8").alias("content"))
    return e.cell_rows(e.extract(files)).select("file_id", "row", "column", "text", "header")


Q.add(
    "csv_cells", _csv_cells,
    """WITH n AS (SELECT o_custkey AS f, o_orderkey AS k, o_orderpriority AS p, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS r FROM orders)
      SELECT f AS file_id, r AS row, 0 AS column, lpad(CAST(k AS VARCHAR), 12, '0') AS text, FALSE AS header FROM n UNION ALL
      SELECT f, r, 1, p, FALSE FROM n UNION ALL SELECT DISTINCT f, 0, 0, 'key', TRUE FROM n UNION ALL SELECT DISTINCT f, 0, 1, 'priority', TRUE FROM n""",
)
Q.add(
    "heading_levels", lambda s, d: e.heading_levels(t.blocks(s, d)).select("doc_id", "ordinal", "level"),
    t.with_views("SELECT doc_id, ordinal, CASE WHEN font_size > min(font_size) OVER (PARTITION BY doc_id) THEN CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS INTEGER) END AS level FROM blocks", "blocks"),
)
Q.add(
    "first_title", lambda s, d: e.first_title(e.heading_levels(t.blocks(s, d))),
    t.with_views(""", l AS (SELECT *, CASE WHEN font_size > min(font_size) OVER (PARTITION BY doc_id) THEN dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC) END AS level FROM blocks)
      SELECT doc_id, first(text ORDER BY CASE type WHEN 'title' THEN 0 ELSE 1 END, ordinal) AS title FROM l WHERE type = 'title' OR (type = 'heading' AND level = 1) GROUP BY doc_id""", "blocks"),
)
Q.add("list_items", lambda s, d: t.blocks(s, d).select("doc_id", "ordinal", x.is_list_item(F.col("text")).alias("is_list_item")), t.with_views(r"SELECT doc_id, ordinal, regexp_matches(text, '^(•|-|\*|[0-9][.)])') AS is_list_item FROM blocks", "blocks"))
Q.add("page_blocks", lambda s, d: e.page_blocks(t.blocks(s, d)), t.with_views("SELECT doc_id, page_number, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) AS block_ids FROM blocks WHERE page_number IS NOT NULL GROUP BY ALL", "blocks"))
Q.add(
    "redundant_table_items", lambda s, d: e.without_table_parts(t.blocks(s, d).withColumn("parent", F.when(F.col("ordinal") % 3 != 0, F.col("ordinal") - 1))).select("doc_id", "ordinal"),
    t.with_views(""", b AS (SELECT *, CASE WHEN ordinal % 3 <> 0 THEN ordinal - 1 END AS parent FROM blocks) SELECT b.doc_id, b.ordinal FROM b LEFT JOIN b p ON p.doc_id = b.doc_id AND p.ordinal = b.parent
      LEFT JOIN b g ON g.doc_id = p.doc_id AND g.ordinal = p.parent WHERE coalesce(p.type, '') <> 'table' AND coalesce(g.type, '') <> 'table'""", "blocks"),
)


def _quality(s: SparkSession, d: str) -> DataFrame:
    return e.quality(t.blocks(s, d).withColumns({"has_provenance": F.col("page_number").isNotNull(), "valid_table": F.coalesce(F.col("n_columns") > 2, F.lit(False))}))


# Words are told apart by letters and digits of all scripts on both sides; the oracle spells the classes out.
_ODD = r"regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])[\p{L}\p{M}\p{N}\p{Pc}]+(percent|the|and|or|of|to)($|[^\p{L}\p{M}\p{N}\p{Pc}])')"
_NUM = r"len(list_filter(string_split_regex(trim(text), '\s+'), lambda v: regexp_matches(regexp_replace(v, '^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$', '', 'g'), '^(?:[0-9]+(?:\.[0-9]+)?%?|[0-9]{1,3}(?:,[0-9]{3})+)$')))"
_SCORED = f""", b AS (SELECT *, {_ODD} AS odd, len(string_split_regex(trim(text), '\\s+')) >= 4 AND {_NUM} >= 2 AS like_table FROM blocks),
      a AS (SELECT doc_id, count(*) AS n, sum(length(trim(text))) AS chars, count(*) FILTER (odd) AS odd, avg(CASE WHEN page_number IS NOT NULL THEN 1.0 ELSE 0.0 END) AS p, max(CAST(type IN ('heading', 'title') AS INTEGER)) AS h, max(CAST(type = 'paragraph' AS INTEGER)) AS g,
        max(CAST(type = 'list_item' AS INTEGER)) AS l, count(*) FILTER (type = 'table') AS tb, count(*) FILTER (type = 'table' AND n_columns > 2) AS ok, bool_or(like_table) AS like_table FROM b GROUP BY doc_id),
      q AS (SELECT doc_id, odd > 0 AS suspicious, like_table AS table_like, CAST(0.4 AS DOUBLE) + CAST(0.4 AS DOUBLE) * CASE WHEN chars < 50 THEN CAST(0.4 AS DOUBLE) WHEN chars < 200 THEN CAST(0.7 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END + CAST(0.2 AS DOUBLE) * greatest(0, 1 - least(2 * odd / n, 1)) AS t,
        least(1, CAST(0.35 AS DOUBLE) * CAST(n >= 2 AS INTEGER) + CAST(0.30 AS DOUBLE) * h + CAST(0.20 AS DOUBLE) * g + CAST(0.15 AS DOUBLE) * l) AS s, CASE WHEN tb > 0 THEN ok / tb ELSE 0 END AS b, CAST(p AS DOUBLE) AS p FROM a),
      r AS (SELECT doc_id, round(t, 3) AS text_score, round(s, 3) AS structure_score, round(b, 3) AS table_score, round(p, 3) AS provenance_score, round(CAST(0.5 AS DOUBLE) * t + CAST(0.2 AS DOUBLE) * s + CAST(0.1 AS DOUBLE) * b + CAST(0.2 AS DOUBLE) * p, 3) AS overall_score, suspicious, table_like FROM q)"""
Q.add("quality_scores", _quality, t.with_views(_SCORED + " SELECT * FROM r", "blocks"))
Q.add(
    "quality_warnings", lambda s, d: _quality(s, d).select("doc_id", e.warnings().alias("warnings")),
    t.with_views(_SCORED + """ SELECT doc_id, concat_ws(',', CASE WHEN text_score < 0.7 THEN 'low_text' END, CASE WHEN structure_score < 0.4 THEN 'little_structure' END, CASE WHEN table_like AND table_score = 0 THEN 'table_lost' END,
      CASE WHEN provenance_score < 0.9 THEN 'provenance_missing' END, CASE WHEN suspicious THEN 'artifacts' END) AS warnings FROM r""", "blocks"),
)
Q.add(
    "extraction_policy", lambda s, d: _quality(s, d).select("doc_id", e.policy().alias("decision"), e.reasons().alias("reasons")),
    t.with_views(_SCORED + """, p AS (SELECT doc_id, concat_ws(',', CASE WHEN text_score < 0.75 THEN 'text' END, CASE WHEN provenance_score < 0.8 THEN 'provenance' END, CASE WHEN overall_score < 0.6 THEN 'overall' END) AS reasons FROM r)
      SELECT doc_id, CASE WHEN reasons = '' THEN 'accept' ELSE 'fallback' END AS decision, reasons FROM p""", "blocks"),
)
Q.add("block_counts", lambda s, d: e.block_counts(t.blocks(s, d)), t.with_views("SELECT doc_id, " + ", ".join(f"count(*) FILTER (type = '{k}') AS {k}" for k in ("title", "heading", "paragraph", "list_item", "table")) + " FROM blocks GROUP BY doc_id", "blocks"))
Q.add(
    "limits_check", lambda s, d: t.table(s, d, "part").select("p_partkey", e.within_limits(F.col("p_partkey") * 300, F.col("p_size") * 50).alias("ok")),
    "SELECT p_partkey, p_partkey * 300 <= 500000 AND p_size * 50 <= 2000 AND p_partkey * 300 * p_size * 50 <= 5000000 AS ok FROM part",
)


def _parsed_files(s: SparkSession, d: str) -> DataFrame:
    """Pages as HTML files and documents as text, JSON, Markdown, XML and source files."""
    pages = t.table(s, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_id"), F.lit("html").alias("extension"), F.encode("html", "UTF-8").alias("content"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("txt", "json", "md", "xml", "py", "yaml", "rst")]), (F.col("doc_id") % 7 + 1).cast("int"))
    plain = F.regexp_replace("text", "[&<>]", " ")
    body = F.when(kind == "json", F.to_json(F.struct("doc_id", "text"))).when(kind == "xml", F.concat(F.lit("<r><t>"), plain, F.lit("</t></r>"))).when(kind == "yaml", F.concat(F.lit("text: "), F.to_json(F.struct("text")))).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    docs = t.table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), kind.alias("extension"), F.encode(body, "UTF-8").alias("content"))
    return e.extract(pages.unionByName(docs)).select("file_id", "status", "error", "backend", F.size("blocks").alias("n_blocks"), F.size("cells").alias("n_cells"))


Q.add("parse_files", _parsed_files)
