"""A backfill that dies and goes on."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from braidwork.operators import chat
from braidwork.sources import changes, tables
from braidwork.streaming import backfill

SF = "/root/testdata/sf0.001"


def ids(spark, path):
    return sorted(r[0] for r in changes.current(changes.read_log(spark, path), "message_id").select("message_id").collect())


def wanted(m, s):
    return sorted(r[0] for r in chat.index_feed(m, s).select("smsgid").collect())


def test_a_job_that_died_goes_on(spark, tmp_path, monkeypatch):
    m, s = tables.messages(spark, SF), tables.streams(spark, SF)
    n, log, saved = chat.index_feed(m, s).count(), str(tmp_path / "log"), str(tmp_path / "jobs")
    write, calls = changes.append, []

    def dying(rows, path, name):
        if path == log:
            calls.append(name)
        write(rows, path, name)
        if len(calls) == 3 and path == log:
            raise RuntimeError("lost after the write, before the checkpoint")

    monkeypatch.setattr(changes, "append", dying)
    with pytest.raises(RuntimeError):
        backfill.run(m, s, log, saved, "all", page_rows=n // 6)
    monkeypatch.setattr(changes, "append", write)
    c = backfill.saved(spark, saved, "all")
    assert c.page == 2 and not c.done and 0 < c.fetched < n and c.at is not None
    part = backfill.run(m, s, log, saved, "all", page_rows=1, most_pages=1)  # the saved cuts count, not the new size
    assert part.page == 3 and part.cuts == c.cuts and part.at > c.at
    done = backfill.run(m, s, log, saved, "all")
    assert done.done and done.fetched == done.indexed == n and done.page == len(done.cuts) + 1 >= 6
    assert ids(spark, log) == wanted(m, s)
    assert backfill.run(m, s, log, saved, "all") == done
    backfill.clear(spark, saved, "all")
    assert backfill.saved(spark, saved, "all") is None


def test_edges_of_a_backfill(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    columns = "siteid long, sid long, id long, smsgid long, commentvia long, sharemsgid long, msgtype int, message string, archiveid long, role int, messagetime timestamp_ntz, isdeleted boolean, editedon timestamp_ntz"
    row = lambda k, at: (1, 1, k, k, 0, 0, 0, "hi", 1, 2, at, False, None)
    rows = [row(1, None), row(2, None), *[row(k, t0) for k in range(3, 9)], row(9, t0 + timedelta(hours=1)), row(10, t0 + timedelta(hours=2)), row(None, t0 + timedelta(hours=2))]
    m, s = spark.createDataFrame(rows, columns), spark.createDataFrame([(1, 2, False)], "id long, teamstreamtype int, isdeleted boolean")
    path = lambda n: str(tmp_path / n)
    c = backfill.run(m, s, path("a"), path("jobs"), "a", page_rows=2)
    assert (c.fetched, c.indexed) == (11, 10) and ids(spark, path("a")) == list(range(1, 11))
    c = backfill.run(m, s, path("b"), path("jobs"), "b", page_rows=2, since=(t0, 5))
    assert (c.fetched, c.indexed) == (6, 5) and ids(spark, path("b")) == [6, 7, 8, 9, 10]
    c = backfill.run(m.where(F.lit(False)), s, path("c"), path("jobs"), "c")
    assert c.done and c.fetched == 0 and backfill.saved(spark, path("jobs"), "a").job == "a"
