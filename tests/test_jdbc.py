"""Partitioned reads and repeatable inserts against an embedded database of Spark's jars."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.operators import metering
from braidwork.sources import jdbc, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def urls(spark, tmp_path_factory):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "log"))
    return ["jdbc:derby:memory:absent", "jdbc:derby:memory:there;create=true"]


@given(st.lists(st.tuples(st.integers(-100, 100), st.integers(1, 50)), min_size=1, unique_by=lambda c: c[0]), st.integers(1, 9))
@settings(deadline=None, max_examples=200)
def test_cuts(counts, parts):
    counts.sort()
    got = jdbc.cuts(counts, parts)
    assert got == sorted(set(got)) and len(got) < parts and counts[0][0] not in got
    edges, total = [float("-inf"), *got, float("inf")], sum(n for _, n in counts)
    sizes = [sum(n for k, n in counts if a <= k < b) for a, b in zip(edges, edges[1:])]
    assert sum(sizes) == total and max(sizes) < total / parts + 2 * max(n for _, n in counts)


def test_partitioned_read(spark, urls):
    m = tables.messages(spark, SF).select("smsgid", "sid", "msgtype", "messagetime", F.substring("message", 1, 50).alias("message"))
    # Three quarters of the rows in a crowd, the others far away, and a row without a key.
    crowded = m.withColumn("k", F.when(F.col("smsgid") % 4 == 0, F.col("smsgid") * 100_000).otherwise(F.col("smsgid") % 5000 - 100)).select("k", *m.columns)
    odd = crowded.limit(1).withColumn("k", F.lit(None).cast("long"))
    crowded.union(odd).coalesce(2).write.jdbc(urls[1], "messages", "overwrite")
    got = jdbc.read(spark, urls, "messages", "k", 4)
    assert got.rdd.getNumPartitions() in (3, 4)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == m.count() + 1 and max(sizes) < 0.4 * sum(sizes)
    assert sorted(r["smsgid"] for r in got.where("k is not null").collect()) == sorted(r["smsgid"] for r in m.collect())
    plan = got.where("msgtype = 20").select("smsgid")._jdf.queryExecution().toString()
    assert "EqualTo(msgtype,20)" in plan and "ReadSchema: struct<smsgid:bigint>" in plan
    empty = jdbc.read(spark, urls, "(SELECT * FROM messages WHERE 1 = 0) e", "k", 4)
    assert empty.count() == 0
    with pytest.raises(ConnectionError):
        jdbc.read(spark, urls[:1], "messages", "k", 4)


def test_repeated_inserts(spark, urls):
    bills = metering.billed(tables.usage(spark, SF), metering.price_list(spark))
    rows = bills.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("siteid").cast("long").alias("siteid"), F.col("amount").cast("decimal(20,6)").alias("amount"), metering.detail().alias("detail"))
    # Lines that repeat a number are one call here.
    rows = rows.groupBy("call_id").agg(F.max(F.struct("siteid", "amount", "detail")).alias("r")).select("call_id", "r.*")
    n = rows.count()
    jdbc.insert_missing(rows.where("call_id % 3 = 0").union(rows.where("call_id % 3 = 0")), urls, "billing", "call_id")
    jdbc.insert_missing(rows, urls, "billing", "call_id")
    jdbc.insert_missing(rows, urls, "billing", "call_id")
    jdbc.insert_missing(rows.limit(0), urls, "billing", "call_id")
    got = jdbc.read(spark, urls, "billing", "call_id", 4)
    assert got.count() == n == got.select("call_id").distinct().count()
    total = lambda d: d.agg(F.sum("amount")).first()[0]
    assert total(got) == total(rows)
    with pytest.raises(ValueError):
        jdbc.insert_missing(rows.withColumn("call_id", F.lit(None).cast("long")), urls, "billing", "call_id")
