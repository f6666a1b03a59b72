"""Queries against their SQL on rows that tell two rules apart."""

from __future__ import annotations

import datetime as dt
import itertools

import duckdb
import pytest

from braidwork.plans import catalogue

TEXTS = (
    "Doó argabo", "do argabo", "doé?", "What's up", "whaté up", "ſend it to Dana", "meaning of life", "a meaning of　life ", "iś it", "ready? ", "ready?\n", "ready ?\t", "rephraseé it", "İs it so",
    "ıs it so", "list² of all", "listⒶ of all", "is‍it", "send a message to Bob", "tell my tíam that", "improve — all", "improve écrit", "", " ", None,
)


def both(spark, name, table, rows, schema, folder):
    """The query's and the SQL's rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = db.sql(catalogue.ORACLE[name])
    return sorted(map(tuple, catalogue.QUERIES[name](spark, str(folder)).select(*want.columns).collect()), key=str), sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", ["inquiry", "send_action"])
def test_letters_and_blanks_of_all_scripts(spark, tmp_path, name):
    rows = [(i, turn, t) for i, t in enumerate(TEXTS) for turn in (5, 0, 4)]
    got, want = both(spark, name, "conversations", rows, "conv_id long, turn int, text string", tmp_path)
    assert got == want and {x[2] for x in got} == {True, False}
    if name == "inquiry":
        of = {TEXTS[i]: v for i, turn, v in got if turn == 5}
        assert of["do argabo"] and not of["Doó argabo"] and of["ready?\n"] and of["ready? "] and of[None] is False


def test_sums_near_whole_numbers(spark, tmp_path):
    cents = (10, 20, 70)  # as doubles one, or a little less, by their order
    day = dt.datetime(2024, 1, 1)
    orders = [(k, c / 100) for k, p in enumerate(itertools.permutations(cents)) for c in p]
    got, want = both(spark, "request_guards", "orders", [(k, v, day) for k, v in orders], "o_custkey long, o_totalprice double, o_orderdate timestamp_ntz", tmp_path)
    assert got == want
    assert {x[2] for x in got} == {False}  # 1, not 0


def test_requests_without_prices_with_refunds_and_parts_of_seconds(spark, tmp_path):
    day, late = dt.datetime(2024, 1, 1, 0, 0, 0, 500_000), dt.datetime(2024, 4, 3, 0, 0, 1, 200_000)  # 93 days and 0.7 s
    orders = [(0, None, day), (1, None, None), (2, 4.0, day), (2, 1.0, late), *[(10 + i, -i / 2, day) for i in range(13)]]
    got, want = both(spark, "request_guards", "orders", orders, "o_custkey long, o_totalprice double, o_orderdate timestamp_ntz", tmp_path)
    assert got == want
    of = {k: (error, kept) for k, error, kept in got}
    assert of[0] == of[1] == (None, True) and of[2][0] is None and of[14] == (None, False) and of[16] == (None, True)  # -2 and -3
