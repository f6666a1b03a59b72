"""What grows with the input: plans and steps that would not finish on large tables."""

from __future__ import annotations

import re

import duckdb

from braidwork.functions import embedding
from braidwork.operators import search
from braidwork.plans import catalogue
from braidwork.sources import files, postings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_are_kept_by_flag_only(spark, tmp_path):
    rows = [(f, p, float(q)) for f in ("A", "R", None) for p, q in [(None, 3), *((i, i % 50) for i in range(200))]]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["ext_approx"](spark, str(tmp_path))
    want = duckdb.connect().sql(catalogue.ORACLE["ext_approx"].replace("lineitem", f"'{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    sketches = [x for x in plan(got).splitlines() if "approx_count_distinct" in x and "keys=[" in x]
    assert sketches and all("l_partkey" not in re.search(r"keys=\[([^]]*)\]", x)[1] for x in sketches)


def test_a_row_is_summed_before_it_is_shuffled(spark):
    texts = [(i % 400, None if i % 7 == 0 else f"alpha beta w{i % 400} word{i}") for i in range(1200)]
    docs = spark.createDataFrame(texts, "id long, text string")
    whole = spark.createDataFrame([(k, " ".join(own) if own else None) for k in range(400) for own in [[t for i, t in texts if i == k and t]]], "id long, text string")
    both = []
    for rows, size in ((docs, "7"), (whole, "10000")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = embedding.embedded(rows, "id", embedding.weights(rows, "id"))
        assert "Generate" not in plan(got)
        both.append(sorted(map(tuple, got.collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert both[0] == both[1] and len(both[0]) == 400


def test_near_terms_are_told_before_postings_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "quick brown"), (2, "brownie quack"), (3, "other words")], "doc_id long, text string")
    got = search.fuzzy(search.postings(docs, "doc_id"), ["browne"], 3, 2.0)
    assert "LeftSemi" not in plan(got) and {r["doc"] for r in got.collect()} == {1, 2}


def test_terms_of_a_document_are_gathered_in_its_task(spark, monkeypatch):
    monkeypatch.setattr(postings, "AT_ONCE", 3)
    texts = {1: "b a b", 2: "", 3: "a " * 9, 4: "c a", 5: "d"}
    words = spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "doc long, t array<string>").coalesce(1)
    got = [r for b in words.toArrow().combine_chunks().to_batches() for part in postings._by_term(iter([b])) for r in part.to_pylist()]
    want = [{"doc": k, "dl": len(v.split()), "term": w, "positions": [i for i, x in enumerate(v.split()) if x == w]} for k, v in texts.items() for w in sorted(set(v.split()))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_texts_are_encoded_in_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i == 3 else f"é{i}" * 50, "latin-1") for i in range(20)], "id long, text string, charset string").coalesce(1)
    seen = []
    monkeypatch.setattr(files, "PIECE", 200)
    kept = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, run, schema: seen.extend(b for x in df.toArrow().combine_chunks().to_batches() for b in run(iter([x]))) or kept(df, run, schema))
    files.encoded(rows, "id", "text", "charset")
    assert len(seen) > 3 and [x for b in seen for x in b.column(2).to_pylist()] == [r["text"] for r in rows.collect()]
    assert [x for b in seen for x in b.column(0).to_pylist()] == list(range(20))
