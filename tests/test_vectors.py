"""The stored vector index against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import search
from braidwork.sources.vectors import VectorIndex


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 32))
    own = [(int(i), [float(x) for x in centre[i % 12] + 0.3 * r.normal(size=32)]) for i in range(800)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [1.0] * 5), (1004, [float("nan")] * 32), (None, own[0][1])]
    return spark.createDataFrame(own + odd, "vec_id long, embedding array<float>").repartition(3)


def test_all_rows_are_ranked_when_all_are_read(spark, rows, tmp_path):
    index = VectorIndex.write(rows, str(tmp_path / "v"))
    assert sum(index.sizes.values()) == 800 and len(index.sizes) > 10
    known = {r["vec_id"]: r["embedding"] for r in rows.where("vec_id in (3, 40)").collect()}
    again = VectorIndex.open(spark, str(tmp_path / "v"))
    for one in (index, again):
        got = one.search(known, 10, 1000)
        for q, v in known.items():
            want = search.knn(rows.where("vec_id < 800"), v, 10).collect()
            assert [(r["doc"], r["score"]) for r in got.where(f"query = {q}").orderBy("rank").collect()] == [(r["doc"], r["score"]) for r in want]


def test_few_lists_and_vectors_find_most(rows, tmp_path):
    index = VectorIndex.write(rows, str(tmp_path / "v"))
    known = {r["vec_id"]: r["embedding"] for r in rows.where("vec_id < 10").collect()}
    got = {(r["query"], r["doc"]) for r in index.search(known, 20, 120, 0.2).collect()}
    want = {(q, r["doc"]) for q, v in known.items() for r in search.knn(rows.where("vec_id < 800"), v, 20).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert max(sum(index.sizes.get(x, 0) for x in index.probed(np.array(v), 0.2)) for v in known.values()) < 0.4 * 800


def test_filters_go_first(spark, rows, tmp_path):
    index = VectorIndex.write(rows, str(tmp_path / "v"))
    v = rows.where("vec_id = 5").first()["embedding"]
    allowed = rows.where("vec_id % 3 = 1").select(F.col("vec_id").alias("key"))
    got = [r["doc"] for r in index.search({5: v}, 15, 1000, allowed=allowed).orderBy("rank").collect()]
    assert got == [r["doc"] for r in search.knn(rows.where("vec_id % 3 = 1 and vec_id < 800"), v, 15).collect()]
    none = VectorIndex.write(rows.limit(0), str(tmp_path / "none"))
    assert none.search({1: v}, 5, 10).count() == 0
