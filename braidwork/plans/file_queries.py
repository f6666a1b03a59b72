"""Queries of files, charsets, physical encodings and extraction in passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.packing import packed, unpacked
from braidwork.operators import extraction as e
from braidwork.sources import encodings, files
from braidwork.sources import tables as t

from .extraction_queries import _SCORED
from .registry import Registry

Q = Registry()


def _packed(s: SparkSession, d: str) -> DataFrame:
    v = t.table(s, d, "embeddings").select("vec_id", "embedding", packed(F.col("embedding")).alias("data"))
    return v.select("vec_id", F.hex("data").alias("data"), F.coalesce(unpacked(F.col("data")) == F.col("embedding"), F.col("embedding").isNull()).alias("same"))


Q.add(
    "vectors_packed", _packed,
    """WITH v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: hex(CAST(CAST(x AS BIT) AS BLOB))) AS h FROM embeddings)
      SELECT vec_id, CASE WHEN embedding IS NOT NULL THEN coalesce(array_to_string(list_transform(h, lambda x: x[7:8] || x[5:6] || x[3:4] || x[1:2]), ''), '') END AS data, TRUE AS same FROM v""",
)
_FIELDS = ("message_id", "site_id", "sid", "channel_type", "author_archive_id", "thread_root_id", "created_at", "is_deleted", "is_thread_reply")


def _tag_rows(s: SparkSession, d: str) -> DataFrame:
    return encodings.as_tags(t.search_docs(s, d).select(*_FIELDS))


Q.add(
    "tag_rows", _tag_rows,
    t.with_views("""SELECT message_id, CAST(site_id AS VARCHAR) AS site_id, CAST(sid AS VARCHAR) AS sid, coalesce(channel_type, '') AS channel_type, CAST(author_archive_id AS VARCHAR) AS author_archive_id, CAST(thread_root_id AS VARCHAR) AS thread_root_id,
      epoch(created_at) AS created_at, CAST(is_deleted AS VARCHAR) AS is_deleted, CAST(is_thread_reply AS VARCHAR) AS is_thread_reply FROM search_docs""", "search_docs"),
)
Q.add(
    "json_rows", lambda s, d: encodings.as_json(t.search_docs(s, d).select(*_FIELDS)),
    t.with_views("""SELECT message_id, CAST(site_id AS VARCHAR) AS site_id, sid, channel_type, CAST(author_archive_id AS VARCHAR) AS author_archive_id, CAST(thread_root_id AS VARCHAR) AS thread_root_id,
      strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, is_deleted, is_thread_reply FROM search_docs""", "search_docs"),
)


def _readable(s: SparkSession, d: str) -> DataFrame:
    """Pages as files: images, executables, broken UTF-8, text with bells, documents by name, and plain pages."""
    kind = F.col("page_id") % 8
    front = F.when(kind == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(kind == 1, F.unhex(F.lit("616263644D5A"))).when(kind == 2, F.unhex(F.lit("FFFE80"))).when(kind == 4, F.unhex(F.lit("07207A0709"))).otherwise(F.unhex(F.lit("")))
    pages = t.table(s, d, "pages").select("page_id", F.concat(front, F.encode("html", "UTF-8")).alias("content"), F.concat(F.lit("a.b/page"), F.when(kind == 3, ".PDF").when(kind == 5, "").otherwise(".html")).alias("name"))
    return pages.select("page_id", files.extension(F.col("name")).alias("extension"), files.readable(F.col("content"), files.extension(F.col("name"))).alias("text"))


_MARKS = "|".join(m.hex().upper() for m in files.MAGIC)
_HIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
Q.add(
    "readable_files", _readable,
    f"""WITH f AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN '616263644D5A' WHEN 2 THEN 'FFFE80' WHEN 4 THEN '07207A0709' ELSE '' END || hex(encode(html)) AS h,
        CASE page_id % 8 WHEN 4 THEN chr(7) || ' z' || chr(7) || chr(9) ELSE '' END || html AS text, CASE page_id % 8 WHEN 3 THEN '.pdf' WHEN 5 THEN '' ELSE '.html' END AS extension FROM pages),
      c AS (SELECT *, trim(regexp_replace(replace(text, '�', ''), '{_HIDDEN}', '', 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS clean FROM f)
      SELECT page_id, extension, CASE WHEN extension <> '.pdf' AND NOT regexp_matches(h[1:64], '^(..)*?({_MARKS})') AND length(clean) > 5 THEN clean END AS text FROM c""",
)


def _charsets(s: SparkSession, d: str) -> DataFrame:
    """Documents in five charsets, decoded by a model of all texts: whether 95 in 100 of each come back."""
    docs = t.table(s, d, "documents").where("text is not null")
    named = F.element_at(F.array(*[F.lit(c) for c in files.CHARSETS]), (F.pmod("doc_id", F.lit(len(files.CHARSETS))) + 1).cast("int"))
    sent = files.encoded(docs.withColumn("charset", named), "doc_id", "text", "charset").withColumns({"charset": named, "want": F.xxhash64("text")})
    got = files.decoded(sent.withColumn("key", F.struct("doc_id", "charset", "want")), files.fit(docs), "key")
    # A text without further characters has the same bytes in all but the two of two bytes a character, and comes back from any.
    return got.groupBy(F.col("key.charset").alias("charset")).agg(F.count("*").alias("n"), (F.count_if(F.xxhash64("text") == F.col("key.want")) >= 0.95 * F.count("*")).alias("told"))


_NAMES = "[" + ", ".join(f"'{c}'" for c in files.CHARSETS) + "]"
Q.add("charset_detection", _charsets, f"SELECT ({_NAMES})[doc_id % {len(files.CHARSETS)} + 1] AS charset, count(*) AS n, TRUE AS told FROM documents WHERE text IS NOT NULL GROUP BY 1")


def _routed(s: SparkSession, d: str) -> DataFrame:
    """Documents by a first reader, which knows pages of some lines only and little of tables, and for what is rejected by one that knows all pages."""
    docs = t.table(s, d, "documents")
    lines = t.blocks(s, d)

    def reader(provenance):  # noqa: ANN001, ANN202
        def read(asked: DataFrame) -> DataFrame:
            rows = lines.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
            return rows.withColumns({"has_provenance": provenance, "valid_table": F.coalesce(F.col("n_columns") > 2, F.lit(False))})

        return read

    attempts, blocks = e.routed(docs, [("plain", reader(F.col("page_number").isNotNull() & (F.col("doc_id") % 3 != 0))), ("paged", reader(F.lit(True)))], key="doc_id")
    n = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    tried = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["backend"], a["decision"])), ",")
    return attempts.join(n, "doc_id", "left").select("doc_id", "backend", "status", "warnings", tried.alias("attempts"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def _pass(name: str, page: str) -> str:
    """The scores of one pass over ``blocks`` whose page is ``page``, as the view ``name``."""
    text = _SCORED
    for view in "baqr":
        text = text.replace(f", {view} AS (SELECT", f", {view}{name} AS (SELECT").replace(f"      {view} AS (SELECT", f"      {view}{name} AS (SELECT").replace(f"FROM {view})", f"FROM {view}{name})").replace(f"FROM {view} GROUP", f"FROM {view}{name} GROUP")
    return text.replace("FROM blocks", f"FROM (SELECT * REPLACE ({page} AS page_number) FROM blocks)") + f""",
      v{name} AS (SELECT *, text_score >= 0.75 AND provenance_score >= 0.8 AND overall_score >= 0.6 AS ok, concat_ws(',', CASE WHEN text_score < 0.7 THEN 'low_text' END, CASE WHEN structure_score < 0.4 THEN 'little_structure' END, CASE WHEN table_like AND table_score = 0 THEN 'table_lost' END,
        CASE WHEN provenance_score < 0.9 THEN 'provenance_missing' END, CASE WHEN suspicious THEN 'artifacts' END) AS warnings FROM r{name})"""


Q.add(
    "routed_extraction", _routed,
    t.with_views(_pass("1", "CASE WHEN doc_id % 3 <> 0 THEN page_number END") + _pass("2", "1") + """,
      k AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id),
      j AS (SELECT doc_id, v1.ok AS ok1, v2.ok AS ok2, v1.warnings AS w1, v2.warnings AS w2, coalesce(n.n, 0) AS n_blocks FROM k LEFT JOIN v1 USING (doc_id) LEFT JOIN v2 USING (doc_id) LEFT JOIN n USING (doc_id))
      SELECT doc_id, CASE WHEN ok1 THEN 'plain' WHEN ok2 IS NOT NULL THEN 'paged' END AS backend, CASE WHEN ok1 OR ok2 THEN 'accepted' WHEN ok2 IS NULL THEN 'failed' ELSE 'fallback' END AS status, CASE WHEN ok1 THEN w1 ELSE w2 END AS warnings,
        CASE WHEN ok1 THEN 'plain:accept' ELSE CASE WHEN ok1 IS NULL THEN 'plain:failed' ELSE 'plain:fallback' END || ',paged:' || CASE WHEN ok2 THEN 'accept' WHEN ok2 IS NULL THEN 'failed' ELSE 'fallback' END END AS attempts, n_blocks FROM j""", "blocks"),
)
