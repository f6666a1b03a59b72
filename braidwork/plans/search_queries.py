"""Queries of ranked search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.functions import embedding
from braidwork.operators import chat, search
from braidwork.sources import tables as t

from braidwork.sources.folders import shared_folder
from braidwork.sources.postings import Index
from braidwork.sources.vectors import VectorIndex

from .registry import Registry

Q = Registry()
WORDS = "attion to thanedble"
ANY = "attion thanedble ertion"
PREFIX = "to thaned"
FUZZY = "thanedbla attin"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").select("doc_id", "text")


def _leg(kind: str, query: str):  # noqa: ANN202
    def run(s: SparkSession, d: str) -> DataFrame:
        docs = _docs(s, d)
        n, avgdl = search.corpus_size(docs)
        f = {"any": search.any_term, "phrase": search.phrase, "prefix": search.phrase_prefix, "fuzzy": search.fuzzy, "tiered": None}[kind]
        post = search.postings(docs, "doc_id")
        return f(post, search.query_words(query), n, avgdl).select("doc", F.round("score", 6).alias("score"))

    return run


def _post(source: str, key: str) -> str:
    """CTEs: tok, post, tf, dfs, c, sc over a source."""
    return rf"""tok AS (SELECT {key} AS doc, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM {source}),
      post AS (SELECT doc, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS pos FROM tok),
      tf AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM post GROUP BY doc, term),
      dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      c AS (SELECT count(*) AS n, avg(len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))) AS avgdl FROM {source}),
      sc AS (SELECT doc, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM tf JOIN dfs USING (term) CROSS JOIN c)"""


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _legs(any_: str, phrase: str, prefix: str, fuzzy: str) -> str:
    """CTEs: leg_any, leg_phrase, leg_prefix, leg_fuzzy as (doc, score)."""
    a, p, x, z = (search.query_words(q) for q in (any_, phrase, prefix, fuzzy))
    run = lambda ws, last="=": " ".join(f"JOIN post p{i} ON p{i}.doc = p0.doc AND p{i}.pos = p0.pos + {i} AND " + (f"p{i}.term = '{w}'" if last == "=" or i < len(ws) - 1 else f"starts_with(p{i}.term, '{w}')") for i, w in enumerate(ws) if i)
    head = lambda ws, last: f"p0.term = '{ws[0]}'" if last == "=" or len(ws) > 1 else f"starts_with(p0.term, '{ws[0]}')"
    # The oracle's distance counts bytes, so characters beyond ASCII, which no query word has, become one byte first.
    near = " OR ".join(f"(length(term) BETWEEN {len(w) - k} AND {len(w) + k} AND levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '?', 'g'), '{w}') <= {k})" for w in z for k in [search.fuzzy_distance(w)])
    lead = f"term IN {_list(x[:-1])} OR " if x[:-1] else ""
    return f"""leg_any AS (SELECT doc, sum(score) AS score FROM sc WHERE term IN {_list(a)} GROUP BY doc),
      leg_phrase AS (SELECT doc, sum(score) AS score FROM sc WHERE term IN {_list(p)} AND doc IN (SELECT p0.doc FROM post p0 {run(p)} WHERE {head(p, "=")}) GROUP BY doc),
      leg_prefix AS (SELECT doc, sum(score) AS score FROM sc WHERE ({lead}starts_with(term, '{x[-1]}')) AND doc IN (SELECT p0.doc FROM post p0 {run(x, "~")} WHERE {head(x, "~")}) GROUP BY doc),
      leg_fuzzy AS (SELECT doc, sum(score) AS score FROM sc WHERE {near} GROUP BY doc)"""


_ALL = "WITH " + _post("documents", "doc_id") + ", " + _legs(ANY, WORDS, PREFIX, FUZZY)
for _k, _q in (("any", ANY), ("phrase", WORDS), ("prefix", PREFIX), ("fuzzy", FUZZY)):
    Q.add("lexical_any_term" if _k == "any" else f"lexical_{_k}", _leg(_k, _q), f"{_ALL} SELECT doc, round(score, 6) AS score FROM leg_{_k}")


SPEC = search.SearchSpec(query=WORDS, site_id=1, channel_types=(), after=1704067200.0, before=1706400000.0)


_built: dict[tuple[object, ...], Index] = {}


def index_of(s: SparkSession, d: str) -> Index:
    """The stored index of a folder's documents: written by the first query of a session that needs it, read by the others. Other files there mean another index."""
    docs = t.search_docs(s, d)
    key = (s.sparkContext.applicationId, d, *sorted(docs.inputFiles()))
    if key not in _built:
        index = Index(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}")
        index.write(docs, "first", 1)
        _built[key] = index
    return _built[key]


def _tiered(s: SparkSession, d: str) -> DataFrame:
    seen = t.search_docs(s, d).where(search.predicates(SPEC))
    n, avgdl = search.corpus_size(seen)
    return search.top_k(search.tiered(search.postings(seen), SPEC.query, n, avgdl), 20)


def _tiered_stored(s: SparkSession, d: str) -> DataFrame:
    """The same from the stored index."""
    index = index_of(s, d)
    return search.stored_top(index, index.live().where(search.predicates(SPEC)), SPEC.query, 20)


_SEEN = "seen AS (SELECT * FROM search_docs WHERE site_id = 1 AND NOT is_deleted AND created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-28')"
_TIERED = f", {_SEEN}, " + _post("seen", "message_id") + ", " + _legs(WORDS, WORDS, WORDS, WORDS) + """, tiers AS (SELECT doc, round(sum(w * score), 6) AS score FROM (
      SELECT doc, 10 AS w, score FROM leg_phrase UNION ALL SELECT doc, 5, score FROM leg_any UNION ALL SELECT doc, 3, score FROM leg_prefix UNION ALL SELECT doc, 1, score FROM leg_fuzzy) GROUP BY doc)"""
_TOP = " SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM tiers ORDER BY score DESC, doc LIMIT 20"
Q.add("lexical_tiered_topk", _tiered, t.with_views(_TIERED + _TOP, "search_docs"))

Q.add("lexical_tiered_stored", _tiered_stored, Q.oracle["lexical_tiered_topk"])


def _stored_fuzzy(s: SparkSession, d: str) -> DataFrame:
    index = index_of(s, d)
    return search.stored_fuzzy(index, index.live(), search.query_words(FUZZY)).select("doc", F.round("score", 6).alias("score"))


Q.add("lexical_fuzzy_stored", _stored_fuzzy, Q.oracle["lexical_fuzzy"])


def _merged(s: SparkSession, d: str) -> DataFrame:
    """All matches from an index that was written in parts, with rows written twice, changed and deleted ones, and merged."""
    docs = t.search_docs(s, d)
    parts, whole = (Index(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}") for _ in range(2))
    parts.write(docs.withColumn("text", F.concat(F.lit("thanedble attion "), "text")).where("message_id % 3 = 0"), "old", 1)
    parts.write(docs.where("message_id % 2 = 0"), "even", 2)
    parts.delete(docs.where("message_id % 5 = 0"), "gone", 3)
    parts.write(docs.where("message_id % 2 <> 0 or message_id % 5 = 0"), "rest", 4)
    parts.merge(whole, "merged", 5)
    seen = lambda i: i.live().where(search.predicates(SPEC))
    a, b = (search.stored_tiers(i, seen(i), SPEC.query) for i in (parts, whole))
    return a.join(b.select("doc", F.col("score").alias("merged")), "doc", "full")


Q.add("lexical_index_segments", _merged, t.with_views(_TIERED + " SELECT doc, score, score AS merged FROM tiers", "search_docs"))


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return t.table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_COS = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
      v AS (SELECT vec_id AS doc, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS score FROM embeddings CROSS JOIN q)"""
Q.add("knn_exact", lambda s, d: search.knn(t.table(s, d, "embeddings"), _query_vector(s, d), 40), f"WITH {_COS} SELECT doc, score, round(1 - score, 6) AS distance FROM v ORDER BY score DESC, doc LIMIT 40")
Q.add("knn_filtered", lambda s, d: search.knn(t.table(s, d, "embeddings").where("label = 3"), _query_vector(s, d), 40), f"WITH {_COS} SELECT doc, score, round(1 - score, 6) AS distance FROM v WHERE label = 3 ORDER BY score DESC, doc LIMIT 40")


_vectors: dict[tuple[object, ...], VectorIndex] = {}


def vector_index_of(s: SparkSession, d: str) -> VectorIndex:
    """As ``index_of``, of a folder's vectors."""
    rows = t.table(s, d, "embeddings")
    key = (s.sparkContext.applicationId, d, *sorted(rows.inputFiles()))
    if key not in _vectors:
        _vectors[key] = VectorIndex.write(rows, f"{shared_folder(s)}/vectors-{uuid.uuid4().hex}")
    return _vectors[key]


def _recall(s: SparkSession, d: str) -> DataFrame:
    """Of ten queries, the mean share of the exact 40 best that the index finds when it reads a fifth of all vectors, and whether it is 0.9 at least."""
    index, rows = vector_index_of(s, d), t.table(s, d, "embeddings")
    queries = {r["vec_id"]: r["embedding"] for r in rows.where("vec_id % 7 = 0 and vec_id < 70").select("vec_id", "embedding").collect()}
    rerank = sum(index.sizes.values()) // 5
    known = s.createDataFrame([(q, [float(x) for x in v]) for q, v in queries.items()], "query long, q array<double>")
    exact = rows.join(F.broadcast(known)).select("query", F.col("vec_id").alias("doc"), F.round(search.cosine_of(F.col("embedding"), F.col("q")), 6).alias("score"))
    best = exact.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where("r <= 40")
    got = index.search(queries, 40, rerank, 0.9).select("query", "doc", F.lit(1).alias("hit"))
    counted = best.join(got, ["query", "doc"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    return counted.select("wanted", (F.col("hits") >= 0.9 * F.col("wanted")).alias("found"), F.lit(4 * rerank < rows.count()).alias("under_a_quarter"))


Q.add("knn_approximate_recall", _recall, "SELECT 40 * count(*) AS wanted, TRUE AS found, TRUE AS under_a_quarter FROM embeddings WHERE vec_id % 7 = 0 AND vec_id < 70")


def _hybrid_legs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lexical = search.top_k(_leg("any", ANY)(s, d), 100).select("doc", "score")
    return lexical, search.knn(t.table(s, d, "embeddings"), _query_vector(s, d), 100).select("doc", "score")


_HYBRID = f"{_ALL}, {_COS}, l AS (SELECT doc, round(score, 6) AS score FROM leg_any ORDER BY 2 DESC, doc LIMIT 100), m AS (SELECT doc, score FROM v ORDER BY score DESC, doc LIMIT 100)"
Q.add(
    "hybrid_minmax",
    lambda s, d: search.fuse_minmax(*_hybrid_legs(s, d)),
    f"""{_HYBRID}, s AS (SELECT doc, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS x FROM l
      UNION ALL SELECT doc, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END FROM m)
      SELECT doc, round(sum(0.5 * x), 6) AS score FROM s GROUP BY doc""",
)
Q.add(
    "hybrid_rrf",
    lambda s, d: search.fuse_rrf(*_hybrid_legs(s, d)),
    f"""{_HYBRID}, r AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM l UNION ALL SELECT doc, row_number() OVER (ORDER BY score DESC, doc) FROM m)
      SELECT doc, round(sum(1.0 / (60 + r)), 6) AS score FROM r GROUP BY doc""",
)


def _seen(s: SparkSession, d: str) -> DataFrame:
    return t.search_docs(s, d).where(search.predicates(search.SearchSpec(query="x", site_id=1, channel_types=())))


def _acl(s: SparkSession, d: str) -> DataFrame:
    roots = t.search_docs(s, d).where("author_archive_id = 3 and not is_thread_reply").select("thread_root_id")
    return search.authorised(_seen(s, d), chat.allowed_sids(t.members(s, d), 2), roots).select("message_id", "sid", "thread_root_id")


_ALLOWED = "SELECT DISTINCT sid FROM members WHERE archiveid = 2 AND NOT isdeleted AND mode_of_join <> 20"
Q.add(
    "acl_filter", _acl,
    t.with_views(f"""SELECT message_id, sid, thread_root_id FROM search_docs WHERE site_id = 1 AND NOT is_deleted AND (sid IN ({_ALLOWED})
      OR thread_root_id IN (SELECT thread_root_id FROM search_docs WHERE author_archive_id = 3 AND NOT is_thread_reply))""", "members", "search_docs"),
)
Q.add(
    "acl_match_none", lambda s, d: search.authorised(_seen(s, d), t.members(s, d).where("archiveid = -1").select("sid"), t.search_docs(s, d).where("author_archive_id = -1").select("thread_root_id")).select("message_id"),
    t.with_views("SELECT message_id FROM search_docs WHERE FALSE", "search_docs"),
)
Q.add(
    "date_half_open", lambda s, d: t.search_docs(s, d).where(search.predicates(search.SearchSpec(query="x", site_id=2, channel_types=(), after=1704099600.0, before=1705017600.0))).select("message_id", "created_at"),
    t.with_views("SELECT message_id, created_at FROM search_docs WHERE site_id = 2 AND NOT is_deleted AND created_at >= TIMESTAMP '2024-01-01 09:00:00' AND created_at < TIMESTAMP '2024-01-12'", "search_docs"),
)
Q.add(
    "channel_filter", lambda s, d: t.search_docs(s, d).where(search.predicates(search.SearchSpec(query="x", site_id=3))).groupBy("channel_type").agg(F.count("*").alias("n")),
    t.with_views("SELECT channel_type, count(*) AS n FROM search_docs WHERE site_id = 3 AND NOT is_deleted AND channel_type IN ('dm', 'private_channel') GROUP BY 1", "search_docs"),
)
Q.add(
    "modifier_filter", lambda s, d: t.search_docs(s, d).where(search.predicates(search.SearchSpec(query="x", site_id=3, channel_types=(), from_ids=(1, 4), in_ids=(3, 8, 13)))).select("message_id"),
    t.with_views("SELECT message_id FROM search_docs WHERE site_id = 3 AND NOT is_deleted AND author_archive_id IN (1, 4) AND sid IN (3, 8, 13)", "search_docs"),
)
Q.add(
    "sort_timestamp", lambda s, d: _seen(s, d).select("message_id", "created_at").orderBy(F.desc("created_at"), "message_id").limit(20),
    t.with_views("SELECT message_id, created_at FROM search_docs WHERE site_id = 1 AND NOT is_deleted ORDER BY created_at DESC, message_id LIMIT 20", "search_docs"),
)


def _page2(s: SparkSession, d: str) -> DataFrame:
    scored = _tiered_all(s, d)
    last = search.top_k(scored, 10).orderBy(F.desc("rank")).first()
    order = [("score", "desc"), ("doc", "asc")]
    after = search.keyset_after(scored, order, (last["score"], last["doc"])) if last else scored
    return after.orderBy(F.desc("score"), "doc").limit(10)


Q.add("search_after_page2", _page2, t.with_views(_TIERED + " SELECT doc, score FROM tiers ORDER BY score DESC, doc LIMIT 10 OFFSET 10", "search_docs"))
Q.add(
    "offset_page2", lambda s, d: search.fuse_minmax(*_hybrid_legs(s, d)).orderBy(F.desc("score"), "doc").offset(20).limit(20),
    Q.oracle["hybrid_minmax"] + " ORDER BY score DESC, doc LIMIT 20 OFFSET 20",
)
Q.add("total_hits", lambda s, d: _tiered_all(s, d).agg(F.count("*").alias("total")), t.with_views(_TIERED + " SELECT count(*) AS total FROM tiers", "search_docs"))


def _tiered_all(s: SparkSession, d: str) -> DataFrame:
    seen = t.search_docs(s, d).where(search.predicates(SPEC))
    n, avgdl = search.corpus_size(seen)
    return search.tiered(search.postings(seen), SPEC.query, n, avgdl)


def _request(s: SparkSession, d: str, stored: bool = False) -> DataFrame:
    """A whole hybrid request: access, filters, both legs, rank fusion and a page."""
    vectors = t.table(s, d, "embeddings").select(F.col("vec_id").alias("message_id"), "embedding")
    spec = search.SearchSpec(query=WORDS, site_id=1, channel_types=(), methods=("lexical", "semantic"), fusion="rrf")
    out = search.search(index_of(s, d) if stored else t.search_docs(s, d), spec, sids=chat.allowed_sids(t.members(s, d), 2), roots=t.search_docs(s, d).where("author_archive_id = 3").select("thread_root_id"), vectors=vectors, query_vector=_query_vector(s, d))
    return search.positions(out).select("message_id", "score", "rank", F.col("sort_values")[0].alias("place"))


_MINE = f"""seen AS (SELECT * FROM search_docs WHERE site_id = 1 AND NOT is_deleted AND (sid IN ({_ALLOWED}) OR thread_root_id IN (SELECT thread_root_id FROM search_docs WHERE author_archive_id = 3)))"""
Q.add(
    "search_request", _request,
    t.with_views(_TIERED.replace(_SEEN, _MINE) + f""", {_COS}, l AS (SELECT doc, score FROM tiers ORDER BY score DESC, doc LIMIT 100),
      m AS (SELECT doc, score FROM v WHERE doc IN (SELECT message_id FROM seen) ORDER BY score DESC, doc LIMIT 5),
      r AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM l UNION ALL SELECT doc, row_number() OVER (ORDER BY score DESC, doc) FROM m),
      f AS (SELECT doc AS message_id, round(sum(1.0 / (60 + r)), 6) AS score FROM r GROUP BY doc),
      p AS (SELECT message_id, score, row_number() OVER (ORDER BY score DESC, message_id) AS rank FROM f)
      SELECT message_id, score, rank, rank AS place FROM p WHERE rank <= 20""", "members", "search_docs"),
)
Q.add("search_request_stored", lambda s, d: _request(s, d, stored=True), Q.oracle["search_request"])


def _names(s: SparkSession, d: str) -> DataFrame:
    """Customers as authors, nations as channels."""
    people = t.table(s, d, "customer").select(F.col("c_custkey").alias("im_archiveid"), F.col("c_name").alias("username"))
    places = t.table(s, d, "nation").select(F.col("n_nationkey").alias("sid"), F.col("n_name").alias("name"))
    names = {"from": [r["username"].upper() for r in people.where("im_archiveid in (3, 7, 8)").collect()], "in": [r["name"].lower() for r in places.where("sid % 3 = 1").collect()]}
    return search.named(t.search_docs(s, d), names, people, places).select("message_id")


Q.add(
    "named_modifiers", _names,
    t.with_views("""SELECT message_id FROM search_docs WHERE author_archive_id IN (SELECT c_custkey FROM customer WHERE c_name IN (SELECT c_name FROM customer WHERE c_custkey IN (3, 7, 8)))
      AND sid IN (SELECT n_nationkey FROM nation WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 1))""", "search_docs"),
)


def _hashed(s: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents by the default embedder, with weights of all: their size, and whether they are of length one."""
    docs = t.table(s, d, "documents").select("doc_id", "text")
    got = embedding.embedded(docs, "doc_id", embedding.weights(docs, "doc_id"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return got.select("doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n"), (F.abs(length - 1) < 1e-6).alias("unit"))


Q.add("embed_hashed", _hashed, r"SELECT doc_id, CASE WHEN text IS NOT NULL THEN 384 END AS n, CASE WHEN text IS NOT NULL THEN regexp_matches(text, '[\p{L}\p{N}]') END AS unit FROM documents")
