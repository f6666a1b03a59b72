"""The stored index against ranking by scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators import search
from braidwork.sources import postings
from braidwork.sources.postings import Index

R = random.Random(5)
WORDS = ["".join(R.choice("abcde") for _ in range(R.randrange(1, 9))) for _ in range(120)]


def texts(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS, weights=[1 / (k + 1) for k in range(len(WORDS))], k=r.randrange(0, 60)))) for i in range(n)]


def rows(df):
    return sorted((r["doc"], round(r["score"], 5)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Rows written twice, changed and deleted, in four segments; and what is left of them."""
    first, second = texts(150, 1), texts(60, 2)
    i = Index(spark, str(tmp_path_factory.mktemp("index")) + "/i", key="id")
    table = lambda r: spark.createDataFrame(r, "id long, text string").withColumn("site", F.col("id") % 3)
    i.write(table(first), "a", 1)
    i.write(table(second), "b", 2)
    i.delete(table(second).where("id < 20").select("id"), "c", 3)
    i.write(table([(5, "back again " + WORDS[3]), (900, None)]), "d", 4)
    final = {k: v for k, v in (dict(first) | dict(second)).items() if k >= 20} | {5: "back again " + WORDS[3], 900: ""}
    return i, table(sorted(final.items()))


@pytest.mark.parametrize(("k", "probed", "listed"), [(10, 100, 1000), (3, 4, 1000), (5, 2, 12), (0, 100, 1000)])
def test_stored_ranking_equals_the_scan(index, monkeypatch, k, probed, listed):
    monkeypatch.setattr(search, "PROBED", probed)
    monkeypatch.setattr(search, "LISTED", listed)
    monkeypatch.setattr(postings, "LISTED", listed)
    i, docs = index
    r = random.Random(k)
    for site in (None, 1):
        own = docs if site is None else docs.where(f"site = {site}")
        visible = i.live() if site is None else i.live().where(f"site = {site}")
        query = " ".join(r.choices(WORDS[:40], k=r.randrange(1, 4)))
        n, avgdl = search.corpus_size(own)
        want = search.tiered(search.postings(own, "id"), query, n, avgdl)
        assert rows(search.stored_tiers(i, visible, query)) == rows(want)
        got = [(r_["doc"], round(r_["score"], 5), r_["rank"]) for r_ in search.stored_top(i, visible, query, k).orderBy("rank").collect()]
        assert got == [(r_["doc"], round(r_["score"], 5), r_["rank"]) for r_ in search.top_k(want, k).orderBy("rank").collect()]


def test_near_terms_are_looked_up(index):
    i, docs = index
    post = search.postings(docs, "id")
    n, avgdl = search.corpus_size(docs)
    for word in (WORDS[2], "abcdea", "edcbaedcb", "aabbccdde"):
        assert rows(search.stored_fuzzy(i, i.live(), [word])) == rows(search.fuzzy(post, [word], n, avgdl))
    spelled = [*WORDS[:20], "é", "日本", ""]
    assert [postings.bucket_of(w) for w in spelled] == [r[0] for r in i.spark.createDataFrame(list(enumerate(spelled)), "i int, w string").orderBy("i").select(postings.bucket(F.col("w"))).collect()]


def test_variants_meet_within_two_edits(spark):
    r = random.Random(9)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abc") for _ in range(r.randrange(1, 14)))
        b = list(a)
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "x", "a"])
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("d"), postings.variants(F.col("b")).alias("v")).collect()
    for x in got:
        assert x["d"] > 2 or set(postings.variants_of(x["a"], x["d"])) & set(x["v"]), (x["a"], x["b"])


def test_a_query_reads_its_terms_partitions_only(index):
    i, _ = index
    s = search.Stored.of(i, i.live(), ["zzz"], prefix=False, near=False)
    plan = s.postings._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.partition("PartitionFilters")[2].partition("]")[0] and "zzz" in plan.partition("PushedFilters")[2].partition("]")[0]
    scan = s.postings.select("docs", "term")._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in scan.partition("ReadSchema")[2]


def test_merged_segments_hold_the_same(index, spark, tmp_path):
    i, docs = index
    whole = Index(spark, str(tmp_path / "w"), key="id")
    i.merge(whole, "all", 9)
    assert whole.segments() == ["all"] and whole.live().count() == docs.count()
    assert rows(search.stored_tiers(whole, whole.live(), f"{WORDS[0]} {WORDS[3]}")) == rows(search.stored_tiers(i, i.live(), f"{WORDS[0]} {WORDS[3]}"))
    with pytest.raises(ValueError):
        i.write(docs, "7", 10)
    empty = Index(spark, str(tmp_path / "e"), key="id")
    empty.write(docs.limit(0), "none", 1)
    assert search.stored_top(empty, empty.live(), "anything", 5).count() == 0


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_nothing_is_shuffled_to_write_or_to_read_postings(spark, tmp_path, monkeypatch):
    i = Index(spark, str(tmp_path / "i"), key="id")
    before = shuffled(spark)
    i.write(spark.createDataFrame(texts(300, 7), "id long, text string"), "a", 1)
    assert shuffled(spark) == before
    monkeypatch.setattr(postings, "LISTED", 1)
    plan = search.Stored.of(i, i.live(), WORDS[:2]).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_slices_are_bounded_by_rows_and_words(spark, monkeypatch):
    monkeypatch.setattr(postings, "SLICE", 3)
    monkeypatch.setattr(postings, "WORDS", 10)
    sizes = [1, 0, 2, 0, 4, 7, 25, 1, 10, 1, 1, 1, 1]
    rows = spark.createDataFrame([(i, ["w"] * n) for i, n in enumerate(sizes)], "doc long, t array<string>").coalesce(1).toArrow().combine_chunks().to_batches()[0]
    got = [[d for b in x for d in b.column(0).to_pylist()] for x in postings._slices(iter([rows.slice(0, 5), rows.slice(5, 0), rows.slice(5)]))]
    assert [d for x in got for d in x] == list(range(len(sizes)))
    assert all(len(x) <= 3 and (len(x) == 1 or sum(sizes[d] for d in x) <= 10) for x in got) and len(got) == 8


@pytest.mark.parametrize("told", ["kept", "either", "dealt"])
def test_merged_slices_are_kept_or_dealt_anew(index, spark, tmp_path, monkeypatch, told):
    """Dead documents go from blocks without a shuffle of postings; those that both bitmaps name are joined, as all are of slices that are hardly filled."""
    i, docs = index
    monkeypatch.setattr(postings, "FILLED", 9 if told == "dealt" else 0)
    full = lambda rows, slot, bits: spark.sparkContext.broadcast(b"\xff" * (bits // 8))
    monkeypatch.setattr(postings, "_bitmap", full if told == "either" else postings._bitmap)
    met = []
    kept = postings._dealt
    monkeypatch.setattr(postings, "_dealt", lambda blocks, *rest: met.append(blocks.count()) or kept(blocks, *rest))
    whole = Index(spark, str(tmp_path / told), key="id")
    i.merge(whole, "all", 9)
    assert sum(met) == 0 if told == "kept" else sum(met) > 0
    own = whole.read("postings").select("term", F.explode(F.arrays_zip("docs", "positions")).alias("e")).select("e.docs", "term", "e.positions")
    want = search.postings(docs, "id").select("doc", "term", "positions")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))
    bounds = whole.read("postings").selectExpr("array_max(transform(positions, x -> size(x))) as tf", "max_tf", "min_dl", "docs").collect()
    size = {r["doc"]: r["dl"] for r in search.postings(docs, "id").collect()}
    assert all(r["tf"] == r["max_tf"] and r["min_dl"] <= min(size[d] for d in r["docs"]) for r in bounds)
    query = f"{WORDS[0]} {WORDS[3]}"
    assert rows(search.stored_tiers(whole, whole.live(), query)) == rows(search.stored_tiers(i, i.live(), query))
