"""The registered queries against their SQL, and the driver contract."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from braidwork.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SAMPLE = ("lexical_tiered_topk", "hybrid_minmax", "hybrid_rrf", "acl_filter", "thread_union", "message_map", "boundary_strength", "binpack", "coverage_gaps", "summary_subsume", "csv_cells", "quality_scores", "billing_rollup", "ext_as_of", "upsert_by_key", "delete_by_id", "delete_by_sid", "embed_batch", "search_request", "search_after_page2", "attachment_links", "document_ids", "summary_delta", "summary_extend", "summary_cache_upsert", "request_guards", "segment_chats", "first_title", "ext_full_join", "stream_boundaries", "stream_batches", "backfill_resumed", "vectors_packed", "tag_rows", "json_rows", "readable_files", "charset_detection", "routed_extraction")


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = db.sql(catalogue.ORACLE[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_contract(spark):
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(catalogue.QUERIES) > 80
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_outside_uses_llm():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, names in os.walk(os.path.join(root, "braidwork")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "braidwork.llm" not in f.read()
