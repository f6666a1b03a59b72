"""Ranked search: filters, tiers with BM25, exact vectors, fusion and paging.

A text query works on postings, (doc, term, tf, positions), so that a query touches only rows of its terms. Each
tier is an equality on terms; fuzzy terms are looked up in the distinct vocabulary first, blocked by length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from braidwork.functions.text import normalize_query, tokens
from braidwork.sources.postings import LISTED, Index

K1, B = 1.2, 0.75
TIERS = {"phrase": 10.0, "any": 5.0, "prefix": 3.0, "fuzzy": 1.0}
RRF_K, DEPTH_FACTOR = 60, 5
#: Documents that are scored first at least.
PROBED = 100
LIMIT, MAX_LIMIT = 20, 100


@dataclass(frozen=True)
class SearchSpec:
    """A request. Times are seconds since 1970; the range is half open."""

    query: str
    site_id: int
    limit: int | None = LIMIT
    after: float | None = None
    before: float | None = None
    channel_types: tuple[str, ...] = ("dm", "private_channel")
    methods: tuple[str, ...] = ("lexical",)
    sort: str = "score"
    direction: str = "desc"
    from_ids: tuple[int, ...] = ()
    in_ids: tuple[int, ...] = ()
    fusion: str = "minmax"
    offset: int = 0
    search_after: tuple[object, ...] | None = None
    content_types: tuple[str, ...] = ("messages",)
    modifiers: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.limit is not None and not 0 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit is 0 to {MAX_LIMIT}")
        if not self.methods or set(self.methods) - {"lexical", "semantic"}:
            raise ValueError("methods are lexical and semantic")
        object.__setattr__(self, "query", normalize_query(self.query))

    @property
    def size(self) -> int:
        return MAX_LIMIT if self.limit is None else self.limit

    @property
    def depth(self) -> int:
        return DEPTH_FACTOR * max(self.size, 1)


def predicates(spec: SearchSpec) -> Column:
    """Tenant, deletion, channel, time and modifiers; all reach the scan."""
    out = [F.col("site_id") == spec.site_id, ~F.col("is_deleted")]
    if spec.channel_types:
        out.append(F.col("channel_type").isin(*spec.channel_types))
    if spec.after is not None:
        out.append(F.col("created_at") >= F.timestamp_seconds(F.lit(spec.after)).cast("timestamp_ntz"))
    if spec.before is not None:
        out.append(F.col("created_at") < F.timestamp_seconds(F.lit(spec.before)).cast("timestamp_ntz"))
    if spec.from_ids:
        out.append(F.col("author_archive_id").isin(*spec.from_ids))
    if spec.in_ids:
        out.append(F.col("sid").isin(*spec.in_ids))
    return reduce(and_, out)


def authorised(docs: DataFrame, sids: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of an allowed stream or of a thread one has written in; nothing if both sets are empty."""
    a = sids.select(F.col(sids.columns[0]).alias("_sid")).distinct().withColumn("_a", F.lit(True))
    r = roots.select(F.col(roots.columns[0]).alias("_root")).distinct().withColumn("_r", F.lit(True))
    both = docs.join(a, docs.sid == F.col("_sid"), "left").join(r, docs.thread_root_id == F.col("_root"), "left")
    return both.where(F.coalesce("_a", F.lit(False)) | F.coalesce("_r", F.lit(False))).select(*docs.columns)


def named(docs: DataFrame, modifiers: dict[str, list[str]], persons: DataFrame | None = None, channels: DataFrame | None = None) -> DataFrame:
    """Documents of the authors and channels that the modifiers name, whatever the case; of any of several names.

    ``persons`` is (im_archiveid, username), where the last part of a user name is a name too; ``channels`` is (sid, name). A name
    that nobody has finds nothing; a kind of modifier without names, or without its table, restricts nothing."""
    authors, places = ([n.lower() for n in modifiers.get(k, [])] for k in ("from", "in"))
    if authors and persons is not None:
        user = F.lower("username")
        short = F.substring_index(F.substring_index(user, "[v]", -1), "_", -1)
        found = persons.where(user.isin(authors) | short.isin(authors)).select(F.col("im_archiveid").alias("author_archive_id"))
        docs = docs.join(found, "author_archive_id", "left_semi")
    if places and channels is not None:
        docs = docs.join(channels.where(F.lower("name").isin(places)).select("sid"), "sid", "left_semi")
    return docs


def postings(docs: DataFrame, key: str = "message_id", text: str = "text") -> DataFrame:
    """(doc, term, tf, positions, dl)"""
    words = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t"))
    one = words.select("doc", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term"))
    return one.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, float]:
    """Documents and mean length: two numbers."""
    r = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl")).first()
    return r["n"], r["avgdl"] or 1.0


def bm25(tf: Column, dl: Column, df: Column, n: int, avgdl: float) -> Column:
    idf = F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def term_scores(post: DataFrame, n: int, avgdl: float) -> DataFrame:
    """(doc, term, positions, score); df is the size of a term's postings, counted for the terms of a query only."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return post.join(df, "term").select("doc", "term", "positions", bm25(F.col("tf"), F.col("dl"), F.col("df"), n, avgdl).alias("score"))


def any_term(post: DataFrame, words: list[str], n: int, avgdl: float) -> DataFrame:
    return term_scores(post.where(F.col("term").isin(words)), n, avgdl).groupBy("doc").agg(F.sum("score").alias("score"))


def phrase(post: DataFrame, words: list[str], n: int, avgdl: float) -> DataFrame:
    """Documents with the words in a row, scored as the sum of their terms."""
    own = term_scores(post.where(F.col("term").isin(words)), n, avgdl)
    row = own.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"), F.sum("score").alias("score"))
    at = [F.coalesce(F.try_element_at("m", F.lit(w)), F.array().cast("array<int>")) for w in words]
    begin = reduce(F.array_intersect, [_shifted(p, i) for i, p in enumerate(at)])
    return row.where(F.size(begin) > 0).select("doc", "score")


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def phrase_prefix(post: DataFrame, words: list[str], n: int, avgdl: float) -> DataFrame:
    """The words in a row, the last one as a prefix."""
    lead, last = words[:-1], words[-1]
    own = term_scores(post.where(F.col("term").isin(lead) | F.col("term").startswith(last)) if lead else post.where(F.col("term").startswith(last)), n, avgdl)
    row = own.groupBy("doc").agg(F.collect_list(F.struct("term", "positions", "score")).alias("m"))
    of = lambda keep: F.flatten(F.transform(F.filter("m", keep), lambda x: x["positions"]))
    begins = [_shifted(of(_is(w)), i) for i, w in enumerate(lead)] + [_shifted(of(lambda x: x["term"].startswith(last)), len(lead))]
    total = F.aggregate("m", F.lit(0.0), lambda a, x: a + x["score"])
    return row.where(F.size(reduce(F.array_intersect, begins)) > 0).select("doc", total.alias("score"))


def _is(word: str):  # noqa: ANN202
    return lambda x: x["term"] == word


def fuzzy_distance(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


def fuzzy_terms(post: DataFrame, words: list[str]) -> DataFrame:
    """Terms of the vocabulary near a word of the query. The words of a query are few; the vocabulary is scanned once."""
    vocabulary = post.select("term").distinct()
    return vocabulary.where(_near(F.col("term"), words))


def _near(term: Column, words: list[str]) -> Column:
    """Within the distance that a word's length allows, lengths first."""
    one = lambda w, k: F.length(term).between(len(w) - k, len(w) + k) & F.levenshtein(term, F.lit(w), k).between(0, k) if k else term == w
    return reduce(lambda a, b: a | b, [one(w, fuzzy_distance(w)) for w in words])


def fuzzy(post: DataFrame, words: list[str], n: int, avgdl: float) -> DataFrame:
    """Documents with terms near a word. The terms are told before the postings are grouped, so those of other terms aren't shuffled."""
    return term_scores(post.where(_near(F.col("term"), words)), n, avgdl).groupBy("doc").agg(F.sum("score").alias("score"))


def tiered(post: DataFrame, query: str, n: int, avgdl: float) -> DataFrame:
    """(doc, score): weighted sum of the tiers that match, at least one.

    The postings of all terms that any tier may use are read and scored once; the tiers are then expressions
    over a document's few matching terms, and equal the sum of the single legs."""
    words = query_words(query)
    return _tiers(term_scores(post.where(F.col("term").isin(words) | F.col("term").startswith(words[-1]) | _near(F.col("term"), words)), n, avgdl), words)


def _tiers(rows: DataFrame, words: list[str]) -> DataFrame:
    """(doc, score) from the (doc, term, positions, score) of all terms that a tier may use."""
    lead, last = words[:-1], words[-1]
    row = rows.groupBy("doc").agg(F.collect_list(F.struct("term", "positions", "score")).alias("m"))
    total = lambda keep: F.aggregate(F.filter("m", keep), F.lit(0.0), lambda a, x: a + x["score"])
    at = lambda keep: F.flatten(F.transform(F.filter("m", keep), lambda x: x["positions"]))
    own = [_shifted(at(_is(w)), i) for i, w in enumerate(words)]
    in_row = lambda begins: F.size(reduce(F.array_intersect, begins)) > 0
    prefixed = [*own[:-1], _shifted(at(lambda x: x["term"].startswith(last)), len(lead))]
    any_ = total(lambda x: x["term"].isin(words))
    of_prefix = total(lambda x: x["term"].isin(lead) | x["term"].startswith(last)) if lead else total(lambda x: x["term"].startswith(last))
    near = total(lambda x: _near(x["term"], words))
    tiers = row.select("doc", any_.alias("a"), F.when(in_row(own), any_).otherwise(0.0).alias("p"), F.when(in_row(prefixed), of_prefix).otherwise(0.0).alias("x"), near.alias("f"))
    return tiers.where("a > 0 or p > 0 or x > 0 or f > 0").select("doc", F.round(TIERS["phrase"] * F.col("p") + TIERS["any"] * F.col("a") + TIERS["prefix"] * F.col("x") + TIERS["fuzzy"] * F.col("f"), 6).alias("score"))


@dataclass(frozen=True)
class Stored:
    """A query's postings of a stored index: those that meet a live document which the caller may see, with the counts of all such."""

    index: Index
    visible: DataFrame
    words: list[str]
    postings: DataFrame
    n: int
    avgdl: float

    @classmethod
    def of(cls, index: Index, visible: DataFrame, words: list[str], *, prefix: bool = True, near: bool = True) -> Stored:
        edits = {w: fuzzy_distance(w) for w in words} if near else {}
        terms = index.expansions(words, words[-1] if prefix else None, edits)
        term = F.col("term")
        matching = (_near(term, words) if near else F.lit(False)) | term.isin(words) | (term.startswith(words[-1]) if prefix else F.lit(False))
        r = visible.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        return cls(index, visible.select(F.col(index.key).alias("doc"), "segment", "dl"), words, index.postings_of(terms, matching), r["n"], r["avgdl"] or 1.0)

    @cached_property
    def found(self) -> DataFrame:
        """(doc, segment, term, slice, max_tf, min_dl, dl): reads no positions. Kept while a query is answered."""
        return self.postings.select("segment", "term", "slice", "max_tf", "min_dl", F.explode("docs").alias("doc")).join(self.visible, ["doc", "segment"]).persist()

    @cached_property
    def frequencies(self) -> DataFrame:
        """(term, df), on the driver while the terms are at most ``LISTED``."""
        counted = self.found.groupBy("term").agg(F.count("*").alias("df"))
        some = counted.limit(LISTED + 1).collect()
        return F.broadcast(self.index.spark.createDataFrame(some, counted.schema)) if len(some) <= LISTED else counted

    def bounds(self) -> DataFrame:
        """(doc, segment, slice, dl, most): no document's score is above ``most``. A block's largest frequency and least length bound its part of each tier; the phrase counts where all its words are."""
        words, term = self.words, F.col("term")
        lead, last = words[:-1], words[-1]
        word = term.isin(words)
        part = bm25(F.col("max_tf"), F.col("min_dl"), F.col("df"), self.n, self.avgdl)
        weight = F.when(word, TIERS["any"]).otherwise(0.0) + F.when(term.isin(lead) | term.startswith(last), TIERS["prefix"]).otherwise(0.0) + F.when(_near(term, words), TIERS["fuzzy"]).otherwise(0.0)
        rows = self.found.join(self.frequencies, "term").select("doc", "segment", "slice", "dl", (part * weight).alias("w"), F.when(word, part).alias("own"))
        most = F.sum("w") + F.when(F.count("own") == len(set(words)), TIERS["phrase"] * F.sum("own")).otherwise(0.0)
        return rows.groupBy("doc", "segment", "slice", "dl").agg(most.alias("most"))

    def listed(self, rows: list[Row], schema: StructType) -> DataFrame:
        """At most ``LISTED`` collected rows of ``bounds``."""
        return F.broadcast(self.index.spark.createDataFrame(rows, schema))

    def rows(self, only: DataFrame | None = None, slices: list[int] | None = None) -> DataFrame:
        """(doc, term, positions, score) of all matching documents, or of those in ``only`` (doc, segment, dl), whose slices are given if they are few."""
        post = self.postings if slices is None else self.postings.where(F.col("slice").isin(slices))
        each = post.select("segment", "term", F.explode(F.arrays_zip("docs", "positions")).alias("e")).select("segment", "term", F.col("e.docs").alias("doc"), F.col("e.positions").alias("positions"))
        own = each.join(self.visible if only is None else only.select("doc", "segment", "dl"), ["doc", "segment"])
        return own.join(self.frequencies, "term").select("doc", "term", "positions", bm25(F.size("positions"), F.col("dl"), F.col("df"), self.n, self.avgdl).alias("score"))


def stored_tiers(index: Index, visible: DataFrame, query: str) -> DataFrame:
    """``tiered`` from a stored index: (doc, score) of all matches. ``visible``: the rows of ``index.live()`` that the caller may see."""
    words = query_words(query)
    return _tiers(Stored.of(index, visible, words).rows(), words)


def stored_top(index: Index, visible: DataFrame, query: str, k: int) -> DataFrame:
    """The best k of ``stored_tiers``, with ranks. Documents with the largest bounds are scored first; the k-th of their scores is a score that k documents reach, so only documents with a bound from there on are scored, from the blocks that hold them."""
    words = query_words(query)
    s = Stored.of(index, visible, words)
    bounds = s.bounds()
    best = bounds.orderBy(F.desc("most"), "doc").limit(LISTED).collect()
    scored = lambda rows: _tiers(s.rows(s.listed(rows, bounds.schema), sorted({r["slice"] for r in rows})), words)
    probed = best[: max(PROBED, 2 * k)]
    first = scored(probed)
    done = first.collect()
    reached = sorted((r["score"] for r in done), reverse=True)[:k]
    least = reached[-1] - 1e-5 if len(reached) == k and k else -math.inf  # scores are rounded to six places
    able = [r for r in best if r["most"] >= least]
    if len(able) == LISTED:  # there may be more
        return top_k(_tiers(s.rows(bounds.where(F.col("most") >= least)), words), k)
    s.found.unpersist()
    return top_k(index.spark.createDataFrame(done, first.schema) if len(able) <= len(probed) else scored(able), k)


def stored_fuzzy(index: Index, visible: DataFrame, words: list[str]) -> DataFrame:
    """``fuzzy`` from a stored index: near terms come from the variants of the words."""
    s = Stored.of(index, visible, words, prefix=False)
    near = s.rows().where(_near(F.col("term"), words))
    return near.groupBy("doc").agg(F.sum("score").alias("score"))


def query_words(query: str) -> list[str]:
    words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    if not words:
        raise ValueError("the query has no words")
    return words


def top_k(scored: DataFrame, k: int, *, key: str = "doc", direction: str = "desc") -> DataFrame:
    """Ties by key; rank from 1."""
    best = scored.orderBy(F.desc("score") if direction == "desc" else F.asc("score"), key).limit(k)
    order = F.desc("score") if direction == "desc" else F.asc("score")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(order, key)))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda a, b: a + b))


def _product(v: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)


def cosine(v: Column, query: list[float]) -> Column:
    """In double precision; null if a side has no length."""
    return _product(v, F.lit([float(x) for x in query])) / F.nullif(_length(v) * math.sqrt(sum(x * x for x in query)), F.lit(0.0))


def cosine_of(v: Column, q: Column) -> Column:
    """The same for two columns."""
    return _product(v, q) / F.nullif(_length(v) * _length(q), F.lit(0.0))


def knn(vectors: DataFrame, query: list[float], k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(doc, score, distance): exact, filters go before."""
    scored = vectors.select(F.col(key).alias("doc"), F.round(cosine(F.col(vector), query), 6).alias("score")).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), "doc").limit(k).withColumn("distance", F.round(1 - F.col("score"), 6))


def fuse_minmax(lexical: DataFrame, semantic: DataFrame, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Each leg (doc, score), of bounded size, to 0..1; a leg of equal scores is all 1; mean with weights."""
    legs = lexical.select("doc", "score", F.lit(0).alias("leg")).union(semantic.select("doc", "score", F.lit(1).alias("leg")))
    ends = legs.groupBy("leg").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = legs.join(F.broadcast(ends), "leg").select("doc", "leg", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("s"))
    weight = F.when(F.col("leg") == 0, weights[0]).otherwise(weights[1])
    return scaled.groupBy("doc").agg(F.round(F.sum(F.col("s") * weight), 6).alias("score"))


def fuse_rrf(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the legs, each of bounded size."""
    ranked = lambda leg: leg.select("doc", F.row_number().over(Window.orderBy(F.desc("score"), "doc")).alias("r"))
    return ranked(lexical).union(ranked(semantic)).groupBy("doc").agg(F.round(F.sum(1 / (k + F.col("r"))), 6).alias("score"))


def keyset_after(rows: DataFrame, order: list[tuple[str, str]], last: tuple[object, ...]) -> DataFrame:
    """Rows strictly after the last sort values, for (column, direction) pairs."""
    cond, equal = F.lit(False), F.lit(True)
    for (c, direction), value in zip(order, last):
        v = F.lit(value).cast(rows.schema[c].dataType)
        cond = cond | (equal & (F.col(c) < v if direction == "desc" else F.col(c) > v))
        equal = equal & (F.col(c) == v)
    return rows.where(cond)


def _matches(docs: DataFrame, spec: SearchSpec, sids: DataFrame, roots: DataFrame, vectors: DataFrame | None, query_vector: list[float] | None, index: Index | None = None) -> DataFrame:
    """Document columns and score of all matches; counts, lengths and frequencies are those of the rows that the caller may see.

    With an index, ``docs`` are its live rows, and their texts aren't read."""
    seen = authorised(docs.where(predicates(spec)), sids, roots)
    legs: list[DataFrame] = []
    hybrid = len(set(spec.methods)) == 2
    if "lexical" in spec.methods:
        if index is not None:
            legs.append(stored_top(index, seen, spec.query, spec.depth) if hybrid else stored_tiers(index, seen, spec.query))
        else:
            n, avgdl = corpus_size(seen)
            legs.append(tiered(postings(seen), spec.query, n, avgdl))
    if "semantic" in spec.methods:
        if vectors is None or query_vector is None:
            raise ValueError("semantic search needs vectors and a query vector")
        k = max(1, min(spec.size // 4, spec.size - 1)) if hybrid else 2 * max(spec.size, 1)
        legs.append(knn(vectors.join(seen.select("message_id"), "message_id", "left_semi"), query_vector, k, key="message_id").select("doc", "score"))
    if hybrid:
        bounded = top_k(legs[0], spec.depth).select("doc", "score")
        scored = fuse_rrf(bounded, legs[1]) if spec.fusion == "rrf" else fuse_minmax(bounded, legs[1])
    else:
        scored = legs[0]
    return scored.join(seen, scored.doc == seen.message_id).drop("doc")


def _page(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    order = _order(spec)
    if spec.search_after is not None:
        rows = keyset_after(rows, order, spec.search_after)
    by = [F.desc(c) if d == "desc" else F.asc(c) for c, d in order]
    page = rows.orderBy(*by).offset(spec.offset).limit(spec.size)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def _order(spec: SearchSpec) -> list[tuple[str, str]]:
    return [("score" if spec.sort == "score" else "created_at", spec.direction), ("message_id", "asc")]


def search(
    docs: DataFrame | Index, spec: SearchSpec, *, sids: DataFrame, roots: DataFrame, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    persons: DataFrame | None = None, channels: DataFrame | None = None,
) -> DataFrame:
    """Candidates of a request: document columns, score and rank, from documents or from a stored index of them. ``vectors`` is (message_id, embedding).

    Names of the spec's modifiers are looked up in ``persons`` and ``channels`` (see ``named``)."""
    index, rows = (docs, docs.live()) if isinstance(docs, Index) else (None, docs)
    order = rows.columns
    rows = named(rows, spec.modifiers, persons, channels).select(*order)
    return _page(_matches(rows, spec, sids, roots, vectors, query_vector, index), spec)


@dataclass(frozen=True)
class Result:
    """Of one content type. ``total`` counts all matches, whatever the page; it is None if the type was exhausted or failed."""

    candidates: list[Row]
    total: int | None = None
    error: str | None = None

    @property
    def status(self) -> str:
        return "success" if self.error is None else "error"


@dataclass(frozen=True)
class Response:
    results: dict[str, Result]
    next_cursor: str | None


def respond(
    docs: dict[str, DataFrame], spec: SearchSpec, cursor: str | None = None, *, sids: DataFrame, roots: DataFrame, vectors: DataFrame | None = None, query_vector: list[float] | None = None
) -> Response:
    """A page of each content type that ``spec`` asks for, with totals and the cursor of the next page.

    A page is at most ``MAX_LIMIT`` rows, which come to the driver with their count in one job a type. Hybrid search by
    score pages by offset, as its scores belong to one bounded fusion; all else goes on after the last row. A
    page that isn't full exhausts its type, as a failure does, and an exhausted type stays so."""
    before = None if cursor is None else decode_cursor(cursor)
    if before is not None:
        check_cursor(before, spec)
    by_offset = len(set(spec.methods)) == 2 and (spec.sort, spec.direction) == ("score", "desc")
    results: dict[str, Result] = {}
    after: dict[str, list[object] | None] = {}
    for kind in spec.content_types:
        last = before.search_after.get(kind, []) if before else []
        if last is None:
            results[kind], after[kind] = Result([]), None
            continue
        at = int(last[0]) if by_offset and last else 0  # type: ignore[call-overload]
        one = replace(spec, offset=at, search_after=None if by_offset or not last else tuple(last))
        found = Observation()
        try:
            if kind not in docs:
                raise ValueError(f"no index for {kind}")
            rows = _matches(docs[kind], one, sids, roots, vectors, query_vector).observe(found, F.count(F.lit(1)).alias("n"))
            page = _page(rows, one).orderBy("rank").collect() if spec.size else []
        except Exception as e:  # noqa: BLE001 one type's failure leaves the others
            results[kind], after[kind] = Result([], error=str(e)), None
            continue
        results[kind] = Result(page, found.get["n"] if spec.size else None)
        full = bool(page) and len(page) == spec.size
        values = [at + len(page)] if by_offset else [_plain(page[-1][c]) for c, _ in _order(spec)] if full else []
        after[kind] = values if full else None
    done = all(v is None for v in after.values())
    return Response(results, None if done else encode_cursor(Cursor(query_hash(spec), spec.sort, spec.direction, spec.depth, after)))


def _plain(value: object) -> object:
    """As JSON can hold it; times come back by a cast."""
    return value.isoformat(sep=" ") if isinstance(value, datetime) else value


def positions(page: DataFrame, offset: int = 0) -> DataFrame:
    """Adds sort_values, the place of each row of a page in the whole result."""
    return page.withColumn("sort_values", F.array((F.lit(offset) + F.col("rank")).cast("long")))


@dataclass(frozen=True)
class Cursor:
    query_hash: str
    sort: str
    direction: str
    depth: int
    search_after: dict[str, list[object] | None]


def _compact(payload: object) -> bytes:
    return json.dumps(payload, separators=(",", ":"), sort_keys=True).encode()


def encode_cursor(c: Cursor) -> str:
    return base64.urlsafe_b64encode(_compact({"q": c.query_hash, "s": c.sort, "d": c.direction, "pd": c.depth, "sa": c.search_after})).decode()


def decode_cursor(text: str) -> Cursor:
    try:
        x = json.loads(base64.urlsafe_b64decode(text.encode("ascii")))
        return Cursor(x["q"], x["s"], x["d"], int(x["pd"]), {k: None if v is None else list(v) for k, v in x["sa"].items()})
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise ValueError("invalid search cursor") from e


def query_hash(spec: SearchSpec) -> str:
    """Of what must not change between pages; tenant, user, limit and cursor are left out, as access is resolved anew."""
    return hashlib.sha256(
        _compact(
            {
                "query": spec.query, "content_types": list(spec.content_types), "channel_types": list(spec.channel_types), "before": spec.before, "after": spec.after, "include_context_messages": False,
                "modifiers": spec.modifiers, "retrieval_methods": list(spec.methods), "sort": spec.sort, "sort_direction": spec.direction,
            }
        )
    ).hexdigest()


def check_cursor(c: Cursor, spec: SearchSpec) -> None:
    if (c.query_hash, c.sort, c.direction, c.depth) != (query_hash(spec), spec.sort, spec.direction, spec.depth):
        raise ValueError("the cursor belongs to another search")


def next_cursor(spec: SearchSpec, last: tuple[object, ...] | None, before: Cursor | None = None, content_type: str = "messages") -> str | None:
    """None if every content type is exhausted. An exhausted type stays exhausted."""
    after = dict(before.search_after if before else {}) | {content_type: None if last is None else list(last)}
    return None if all(v is None for v in after.values()) else encode_cursor(Cursor(query_hash(spec), spec.sort, spec.direction, spec.depth, after))


def parse_modifiers(query: str) -> tuple[str, dict[str, list[str]]]:
    """Splits ``from:`` and ``in:`` words off a query."""
    rest, found = [], {"from": [], "in": []}
    for word in query.split():
        head, _, tail = word.partition(":")
        (found[head].append(tail) if head in found and tail else rest.append(word))
    return " ".join(rest), found
