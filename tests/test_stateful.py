"""Streams with state against the batch versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from braidwork.operators import conversation
from braidwork.streaming import stateful

SCHEMA = "sid long, at timestamp, tokens long, id long"
T0 = datetime(2024, 1, 29, 20)


def sample():
    """Messages of three weeks in six conversations, without a silence of over two days, in order of time."""
    rng, rows, k = random.Random(3), [], 0
    for sid in range(6):
        at = T0
        for _ in range(40):
            k += 1
            at += timedelta(minutes=rng.choice([0, 1, 5, 29, 30, 31, 600, 1500]))
            rows.append((sid, at, rng.randint(0, 60), k))
    return sorted(rows, key=lambda r: (r[1], r[3]))


def fed(spark, folder, parts, operator, out):
    """Runs the operator after each part of the input has come; the rows that it has then written."""
    counts = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
        stateful.to_parquet(operator(stream), f"{out}/rows", f"{out}/checkpoint").awaitTermination(300)
        counts.append(spark.read.parquet(f"{out}/rows").count())
    return counts


def test_boundaries_of_a_stream(spark, tmp_path):
    rows = sample()
    cut = len(rows) // 3
    parts = [rows[:cut][::-1], [*rows[cut:], (None, T0, 1, 900), (1, None, 1, 901), (2, rows[0][1], 5, 902)], [(99, rows[-1][1] + timedelta(days=9), 1, 999)]]
    op = lambda s: stateful.boundaries(s, "sid", "at", "tokens", "id", "10 minutes")
    counts = fed(spark, tmp_path / "in", parts, op, tmp_path / "out")
    assert 0 < counts[0] < cut and counts[0] < counts[1] < counts[2] == len(rows)  # 902 came late, 999 still waits
    got = spark.read.parquet(str(tmp_path / "out/rows")).select("id", "strength", "tokens")
    want = conversation.boundary_strength(spark.createDataFrame(rows, SCHEMA), "sid", "at", "id").select("id", "strength", "tokens")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    stateful.to_parquet(op(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), f"{tmp_path}/out/rows", f"{tmp_path}/out/checkpoint").awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == len(rows)  # a restart gives no row twice


def test_batches_of_closed_conversations(spark, tmp_path):
    rows = sample()
    end = rows[-1][1]
    again = [(0, end + timedelta(days=8, minutes=k), 30, 2000 + k) for k in range(5)]
    parts = [rows[:100], rows[100:], [(99, end + timedelta(days=7), 1, 999)], [*again, (98, end + timedelta(days=30), 1, 998)]]
    op = lambda s: stateful.closed_batches(s, "sid", "at", "tokens", "id", 120, 3 * 1440)
    counts = fed(spark, tmp_path / "in", parts, op, tmp_path / "out")
    assert counts[1] < counts[2] == len(rows) and counts[3] == len(rows) + 5 + 1
    done = spark.read.parquet(str(tmp_path / "out/rows"))
    want = conversation.time_aligned_batches(spark.createDataFrame(rows, SCHEMA), "sid", "at", "tokens", 120, "id")
    assert sorted(map(tuple, done.where("id < 900").select("sid", "id", "strength", "batch").collect())) == sorted(map(tuple, want.select("sid", "id", "strength", "batch").collect()))
    later = done.where("id >= 2000").orderBy("id").select("batch", F.col("started") == F.lit(again[0][1]))
    assert [tuple(r) for r in later.collect()] == [(0, True)] * 2 + [(1, True)] * 3
