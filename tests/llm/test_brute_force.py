"""Operators that SQL can't express against plain versions of themselves, and hot keys, depths and clashing names."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braidwork.llm import common, decontaminate, licenses, packing, pii, quality_classifier, queries, tool_calls, warc

from .test_operators import prose, table


def plain_best_fit(sizes, source, cluster, capacity):
    bins, out = [], []  # residual, order of opening, sources, clusters
    for n, s, c in zip(sizes, source, cluster):
        fit = [b for b in bins if b[0] >= n and (s < 0 or s not in b[2]) and (c < 0 or c not in b[3])]
        own = min(fit, key=lambda b: b[0]) if fit else None
        if own is None:
            own = [capacity, len(bins), set(), set()]
            bins.append(own)
        own[0] -= n
        own[2].add(s), own[3].add(c)
        out.append(own[1])
    return out


def test_best_fit_equals_plain_best_fit():
    for seed in range(30):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 300))
        sizes = np.sort(r.choice(200, n, replace=n > 200) + 1)[::-1]
        source, cluster = r.integers(-1, 70, n), r.integers(-1, 90, n)
        got, want = packing.best_fit(sizes, source, cluster, 256), plain_best_fit(sizes.tolist(), source.tolist(), cluster.tolist(), 256)
        # bins of equal residual are interchangeable: the same number of bins, and each piece finds the same tightest space
        free_got, free_want = {}, {}
        for size, x, y in zip(sizes.tolist(), got.tolist(), want):
            assert free_got.get(x, 256) == free_want.get(y, 256)
            free_got[x], free_want[y] = free_got.get(x, 256) - size, free_want.get(y, 256) - size
            if sorted(free_got.values()) != sorted(free_want.values()):
                raise AssertionError(seed)
            if x != y:
                break


def test_equal_rows_are_dealt_to_all_shards(spark):
    d = table(spark, [(1, "same text again")] * 4000)
    rows = packing.pack(d, shard_pieces=500).groupBy(F.shiftright("bin_id", 24).alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("bin_id").alias("bins")).collect()
    assert len(rows) == 8 and max(r["n"] for r in rows) < 700 and all(r["n"] == r["bins"] for r in rows)


def plain_levels(calls):
    out = {}
    for conv in {c for c, _, _ in calls}:
        own = {i: set(d for d in needs or [] if d is not None) for c, i, needs in calls if c == conv}
        level = {}
        while True:
            ready = [i for i in own if i not in level and all(d in level for d in own[i] if d in own)]
            if not ready:
                break
            level |= {i: max([level[d] + 1 for d in own[i] if d in own], default=0) for i in ready}
        out |= {(conv, i): (level.get(i), len(own[i] - own.keys())) for i in own}
    return out


@pytest.mark.parametrize("row_calls", [1000, 3])
def test_levels_equal_a_plain_topological_order(spark, row_calls):
    r = random.Random(5)
    calls = []
    for conv in range(40):
        n = r.randrange(1, 9)
        calls += [(conv, f"c{i}", [r.choice([f"c{r.randrange(n + 1)}", None, "gone"]) for _ in range(r.randrange(3))] or None) for i in range(n)]
    got = tool_calls.levels(spark.createDataFrame(calls, "conv_id long, call_id string, depends_on array<string>"), row_calls).collect()
    assert {(x["conv_id"], x["call_id"]): (x["level"], x["missing"]) for x in got} == plain_levels(calls)


def test_a_deep_chain_of_calls_is_one_row(spark):
    calls = [(1, f"c{i}", i, "measure", '{"words": 1}', [f"c{i - 1}"] if i else []) for i in range(500)]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn int, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame([], "conv_id long, call_id string, turn int, content string")
    linked = tool_calls.link(c, r, tool_calls.SCHEMAS)
    assert {x["call_id"]: x["level"] for x in linked.collect()} == {f"c{i}": i for i in range(500)}
    json = tool_calls.serialised(linked).first()["json"]
    assert json.startswith('[{"arguments":{"words":1},"id":"c0"') and json.index('"c7"') < json.index('"c11"') < json.index('"c499"')
    assert tool_calls.link(c.limit(0), r, tool_calls.SCHEMAS).count() == 0


def test_written_dates_are_permuted_within_their_form(spark):
    first = datetime.date(1990, 1, 1)
    days = [first + datetime.timedelta(i) for i in range(2 * 366)]
    for form in ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d.%m.%Y"):
        given = sorted({d.strftime(form) for d in days})
        rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), "key").collect()
        assert len({r["text"] for r in rows}) == len(given) and {r["n_found"] for r in rows} == {1}
    both = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    rows = {both[r["doc_id"]]: r["text"] for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(both)), "doc_id long, text string"), "key").collect()}
    assert len(set(rows.values())) == len(both)
    assert all((int(a[3:5]) > 12) == (int(b[3:5]) > 12) for a, b in rows.items())


def test_numbers_are_permuted_within_their_plans(spark):
    given = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899, 900, 999) for g in (1, 99) for s in range(1, 120)] + ["000-12-3456", "666-12-3456", "123-00-4567", "123-45-0000"]
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), "key").collect()
    text = {given[r["doc_id"]]: r["text"] for r in rows}
    assert len(set(text.values())) == len(given) and all(text[x] == x for x in given[-4:])
    assert all(y[:3] not in ("000", "666") and y[4:6] != "00" and y[7:] != "0000" for y in map(text.get, given[:-4]))
    phones = ["+49 30 1234567", "+49 301 234 567", "(415) 555-0100", "+1 415 555 0100"]
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(phones)), "doc_id long, text string"), "key").orderBy("doc_id").collect()
    assert [r["text"][:6] for r in rows] == [x[:6] for x in phones[:2]] + ["(415) ", "+1 415"] and all(r["text"] != p for r, p in zip(rows, phones))


def test_columns_that_operators_use_themselves_stay(spark):
    names = ["_found", "_seen", "_kinds", "found", "seen", "kinds", "n_found", "_slot", "slot", "listed", "hit_starts", "n_words", "h", "node", "number"]
    d = spark.createDataFrame([(1, "on 2024-02-29 " + prose(40, 1), *names)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = pii.pseudonymised(d, "k")
    assert out.columns == [*d.columns, "_n_found"] and [out.first()[c] for c in names] == names
    items = spark.createDataFrame([(1, prose(40, 9))], "item_id long, text string")
    for kept in (decontaminate.drop_contaminated(d, items), corpus_pipeline.drop_near_duplicates(spark, d, "")):
        assert kept.columns == d.columns and [kept.first()[c] for c in names] == names


def test_scores_equal_those_of_plain_python(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    d = spark.createDataFrame([(i, prose(30, i) + (" shiny" if i % 2 else " dull")) for i in range(60)] + [(60, None), (61, "ä ß ñandú")], "doc_id long, text string")
    model = quality_classifier.fit(d, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scores(d, model).collect()}
    for r in d.collect():
        raw = (r["text"] or "").encode()
        f, _ = quality_classifier.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), len(model.weight))
        z = model.intercept + sum(float(model.weight[x]) for x in f) / max(1, len(f))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-6


def test_several_blocks_shuffle_no_text(spark):
    items = spark.createDataFrame([(i, prose(40, 700 + i)) for i in range(6)], "item_id long, text string")
    d = table(spark, [(i, f"{prose(30, i)} {prose(40, 700 + i % 6)} {prose(40, 700 + (i + 1) % 6)}") for i in range(12)] + [(20, prose(50, 99)), (20, prose(50, 99))])
    one, many = (sorted(map(tuple, decontaminate.report(d, items, **o).collect())) for o in ({}, {"block_words": 60}))
    assert one == many and sum(x[-1] for x in one) == 12
    plan = decontaminate.matches(d, items, block_words=60)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row" not in plan


def test_many_archives_in_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    monkeypatch.setattr(warc, "WAVES", 1)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "payload " * (20 + i % 3) if i % 7 else None) for i in range(300)], "page_id long, url string, html string")
    raw = warc.write_monolithic(warc.decided(pages), _folder(spark), 1)
    assert raw.agg(F.sum("n_records")).first()[0] == 300
    out = warc.round_trip(pages)
    assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and out.count() == 300


def _folder(spark):
    root = f"{common.shared_dir(spark)}/archives-{random.getrandbits(60)}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return root


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    base, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    want = db.execute(queries.ORACLE[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, base)
    assert sorted(want.column_names) == sorted(got.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, zip(*(want.column(c).to_pylist() for c in columns)))) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_an_empty_pipeline(spark, tmp_path):
    for t, kind in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_domain_of_any_length_is_no_crash(spark):
    texts = ["a@" + "a." * 3000 + "com", "a@" + "a." * 500_000, "mail " + "x.y@" + "b." * 126 + "org now", "a@" * 100_000, "1-" * 300_000, "+1 2 3 " * 50_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.pseudonymised(d, "key").collect()}
    assert [got[i]["n_found"] for i in (0, 1, 2)] == [0, 0, 1] and got[2]["text"].endswith("@" + "b." * 126 + "org now")
    assert all(got[i]["text"] == texts[i] for i in (0, 1))


def test_words_in_common_of_gaps_of_any_length(monkeypatch):
    from braidwork.llm import substring_dedup as s

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    rng = np.random.default_rng(3)
    for room, short in ((s.GAP_BYTES, s.SHORT), (0, 8), (s.GAP_BYTES, 8)):
        monkeypatch.setattr(s, "GAP_BYTES", room)
        monkeypatch.setattr(s, "SHORT", short)
        for _ in range(300):
            words = int(rng.integers(1, 12))
            a, b = rng.integers(0, words, rng.integers(0, 30)), rng.integers(0, words, rng.integers(0, 60))
            assert s._edit_matches(a, b) == s._edit_matches(b, a) == plain(a.tolist(), b.tolist())
    long = rng.integers(0, 3000, 20_000)
    assert s._edit_matches(long, np.delete(long, np.arange(0, 20_000, 10))) == 18_000
    assert s._edit_matches(long, long + 3000) == 0


def test_records_are_inflated_in_pieces():
    import gzip
    import io

    from braidwork.llm import warc

    rows = [(i, f"u{i}", b"a" * n) for i, n in enumerate((0, 5, 3_000_000, 99, 70_000))]
    made = [warc.record(i, u, p, "d", None, False) for i, u, p in rows]
    one, many = gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made))
    for data in (one, many):
        for piece in (64, 1000, 1 << 20):
            assert list(warc.inflated_records(io.BytesIO(data), piece)) == made
    with pytest.raises(ValueError, match="within a record"):
        list(warc.inflated_records(io.BytesIO(gzip.compress(made[1][:-9]))))
