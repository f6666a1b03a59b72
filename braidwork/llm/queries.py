"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, licenses, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup, suffix_dedup, tool_calls, vector_codes, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), quality_classifier.held_out()
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), only=~held)
    return quality_classifier.scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.classes(table(spark, sf_dir, "documents"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.derived(table(spark, sf_dir, "conversations")), tool_calls.SCHEMAS)


#: Of the registered queries, whose results are compared; a real run has a key of its own.
KEY = "registered-query-key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("archive", "offset")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_tool_calls": op4_tool_calls,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc": op9_warc,
    "op10_licenses": op10_licenses,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_LICENSE_WORDS = r"""list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{FFFF}]+'), lambda x: x <> '')"""
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_sql() -> str:
    """One CTE a round: c0 has the first entries, a0 the assignment to them, c1 the next entries, and so on."""
    out = f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FINITE}),
        p AS (SELECT rid, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM k CROSS JOIN range(4) t(part)),
        c0 AS (SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= 256)"""
    for r in range(5):
        out += f""",
        a{r} AS MATERIALIZED (SELECT part, rid, min(d * 256 + entry) AS best FROM (SELECT p.part, rid, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{r} USING (part)) GROUP BY ALL)"""
        if r < 4:
            out += f""",
        s{r} AS (SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS m FROM (
            SELECT part, CAST(best % 256 AS BIGINT) AS entry, i, count(*) AS n, CAST(sum(x[i]) AS BIGINT) AS s FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} JOIN p USING (part, rid)) GROUP BY ALL)),
        c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS m FROM s{r} GROUP BY ALL) USING (part, entry))"""
    return out + """,
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4),
        e AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(best % 256 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 JOIN k USING (rid) GROUP BY rid, vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e CROSS JOIN h"""


_TEMPLATES = ", ".join(f"('{name}', {i}, '{text}')" for name, texts in licenses.TEMPLATES.items() for i, text in enumerate(texts))

ORACLE: dict[str, str] = {
    "op7_decontaminate": f"""
        WITH i AS (SELECT DISTINCT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        iw AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)
        ),
        d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
        dw AS (
            SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
        ),
        h AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
        n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
        o AS (
            SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
            FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
    """,
    "op10_licenses": f"""
        WITH t AS (SELECT license, variant, {_LICENSE_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(license, variant, text)),
        ts AS (SELECT license, variant, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t),
        d AS (SELECT doc_id, {_LICENSE_WORDS} AS w FROM documents),
        ds AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS s FROM d WHERE len(w) > 2),
        c AS (SELECT doc_id, license, len(list_intersect(ts.s, ds.s)) / len(ts.s) AS containment FROM ds CROSS JOIN ts)
        SELECT doc_id, license, max(containment) AS containment FROM c WHERE containment >= 0.8 GROUP BY doc_id, license
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (
            SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY d
        )
        SELECT page_id, octet_length(b) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN octet_length(b) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN octet_length(b) >= 100 AND page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d
    """,
    "op11_hard_negatives": f"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
    """,
    "op12_vector_codes": _lloyd_sql(),
    "op13_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT rid, doc_id, p, md5(hex(b[p:p + 99])) AS g FROM (SELECT rid, doc_id, b, unnest(range(1, octet_length(b) - 98)) AS p FROM d)),
        f AS (SELECT rid, p, row(doc_id, p) > min(row(doc_id, p)) OVER (PARTITION BY g) AS later FROM w),
        r AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM f WHERE later)),
        s AS (SELECT rid, min(p) AS x, max(p) + 100 AS y FROM r GROUP BY rid, run),
        k AS (SELECT rid, x, y, lag(y, 1, 1) OVER (PARTITION BY rid ORDER BY x) AS since FROM s),
        t AS (SELECT rid, count(*) AS n, sum(y - x) AS removed, max(y) AS last, string_agg(hex(b[since:x - 1]), '' ORDER BY x) AS kept FROM k JOIN d USING (rid) GROUP BY rid)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
               sha256(CASE WHEN n IS NULL THEN b ELSE unhex(kept || hex(b[last:])) END) AS kept_sha256
        FROM d LEFT JOIN t USING (rid)
    """,
}
