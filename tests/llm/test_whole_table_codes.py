"""Hard negatives, vector codes and suffix deduplication against plain versions, with nulls, ties, repeated rows, hot groups and clashing names."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import hard_negatives, suffix_dedup, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, v string, block string, code string"
TEXTS = "doc_id long, text string, key string, doc int, spans string"


def plain_negatives(rows):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        seen[i] = min(seen.get(i, own), own)
    ids = np.array(sorted(seen))
    d = max((len(x[1]) for x in seen.values()), default=0)
    rows = np.array([seen[i][1] + [0] * (d - len(seen[i][1])) for i in ids.tolist()]).reshape(len(ids), d)
    labels = np.array([seen[i][0] for i in ids.tolist()])
    out = []
    for a in np.flatnonzero(ids % 50 == 0):
        s = rows @ rows[a]
        order = np.lexsort((ids, -s))
        for p in [x for x in order if x != a and labels[x] == labels[a]][:5]:
            negatives = [x for x in order if labels[x] != labels[a] and 50 * s[p] <= 100 * s[x] <= 95 * s[p]][:3]
            out += [(int(ids[a]), int(ids[p]), k + 1, int(ids[x]), int(s[p]), int(s[x])) for k, x in enumerate(negatives)]
    return sorted(out)


def plain_codes(rows):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    d = max(4, -(-max(len(v) for _, _, v in kept) // 4) * 4)
    v, w = np.array([x + [0] * (d - len(x)) for _, _, x in kept], dtype=np.int64), d // 4
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:256]
    books = [v[first, p * w : (p + 1) * w].copy() for p in range(4)]
    for r in range(5):
        apart = [((v[:, None, p * w : (p + 1) * w] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        nearest, error = [a.argmin(axis=1) for a in apart], sum(a.min(axis=1) for a in apart)
        for p in range(4 if r < 4 else 0):
            for e in np.unique(nearest[p]):
                own = v[nearest[p] == e, p * w : (p + 1) * w]
                books[p][e] = own.sum(axis=0) // len(own)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    total = {}
    for (_, label, _), e in zip(kept, error):
        total[label] = total.get(label, 0) + int(e)
    return sorted(((i, "".join(f"{nearest[p][k]:02x}" for p in range(4)), int(error[k]), total[label], digest) for k, (i, label, _) in enumerate(kept)), key=str)


def plain_repeats(rows, length):
    data = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], (d, i)), (d, i))
    out = []
    for (d, b), (given, _) in zip(data, rows):
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((given, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=(30, 12)) * r.choice([0.01, 1, 5], size=(30, 1))
    rows = [(int(i * 5), [float(np.float32(x)) for x in centre[k] + r.normal(size=12) * 0.05 * np.abs(centre[k]).max()], int(k % 7)) for i, k in enumerate(r.integers(0, 30, 900))]
    rows += [(50, None, 1), (None, [1.0] * 12, 2), (7, [math.nan] * 12, 1), (9, [], 3), (100, [0.0] * 12, 2), (150, [1.0, None], 1), (12, [1.0] * 5, None), (13, [math.inf] * 12, 1), *rows[:5], (rows[10][0], rows[11][1], 3)]
    rows += [(10_000 + i, rows[40][1], 4) for i in range(300)]  # a common vector: ties
    return spark.createDataFrame([(*x, "v", "b", "c") for x in rows], VECTORS).repartition(3)


def given(df):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]


@pytest.mark.parametrize(("block", "asked"), [(2048, 100_000), (100, 20)])
def test_negatives_equal_all_scores(vectors, monkeypatch, block, asked):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ASKED", asked)
    got = sorted(tuple(x) for x in hard_negatives.report(vectors).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = plain_negatives(given(vectors))
    assert got == want and len(want) > 500


def test_blocks_leave_out_only_what_cannot_reach():
    r = np.random.default_rng(4)
    pruned = 0
    for _ in range(30):
        n, d = int(r.integers(1, 400)), int(r.integers(1, 10))
        rows = (r.normal(size=(n, d)) * 300 * r.choice([0.1, 1], size=(n, 1))).astype(np.int64)
        block = hard_negatives.Block(np.arange(n), np.zeros(n, np.int64), rows)
        asked = (r.normal(size=(40, d)) * 300).astype(np.int64)
        truth = asked @ block.rows.T
        least = np.array([math.nan, 0, -5, *np.quantile(truth, 0.99, axis=1)[3:]])
        got = {i: (rows_, s) for i, rows_, s in block.candidates(asked, least)}
        for i in range(40):
            rows_, s = got.get(i, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            assert (s == truth[i, rows_]).all()
            assert np.isnan(least[i]) and len(rows_) == n or set(np.flatnonzero(truth[i] >= least[i])) <= set(rows_.tolist())
            pruned += n - len(rows_)
    assert pruned > 10_000


def test_codes_equal_plain_lloyd(vectors, monkeypatch):
    got = sorted((tuple(x) for x in vector_codes.report(vectors).collect()), key=str)
    assert got == plain_codes(given(vectors))
    few = vectors.where("vec_id < 300")
    assert sorted((tuple(x) for x in vector_codes.report(few).collect()), key=str) == plain_codes(given(few))


def test_two_trees_assign_as_all_distances_do():
    r = np.random.default_rng(1)
    whole = 0
    for t in range(60):
        n, w, k, spread = int(r.integers(1, 900)), int(r.integers(1, 9)), int(r.integers(1, 70)), [2, 40, 10**8][t % 3]
        centre = r.integers(-5 * spread, 5 * spread, (5, w))
        x = centre[r.integers(0, 5, n)] + r.integers(-spread // 2 - 1, spread // 2 + 1, (n, w))
        e = x[r.integers(0, n, k)]
        tree = vector_codes.Tree(x, 32)
        code, error, count, total = vector_codes.assign(tree, np.concatenate([np.zeros((1, w), np.int64), np.cumsum(tree.rows, axis=0)]), e, vector_codes.entry_tree(e))
        apart = ((tree.rows[:, None] - e[None]) ** 2).sum(axis=2)
        want = np.zeros_like(e)
        np.add.at(want, apart.argmin(axis=1), tree.rows)
        assert (code == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all() and (total == want).all()
        assert (count == np.bincount(code, minlength=k)).all()
        whole += int((count > 0).sum())
    assert whole


def test_merged_transforms_are_in_order():
    r = random.Random(1)
    for _ in range(150):
        n, w = r.randrange(2, 60), r.randrange(1, 50)
        strings = [bytes(r.choice(b"ab") for _ in range(w)) for _ in range(n)]
        if r.random() < 0.5:
            strings = [strings[r.randrange(max(1, n // 3))] for _ in range(n)]
        place, alike = suffix_dedup.merged_order(np.frombuffer(b"".join(strings), np.uint8).reshape(n, w), r.randrange(1, n + 1))
        order = np.empty(n, int)
        order[place] = np.arange(n)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        assert [min(int(a), w) for a in alike[1:]] == [next((i for i in range(w) if x[i] != y[i]), w) for x, y in zip(got[:-1], got[1:])]


def test_stretches_cut_runs_but_lose_no_window(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abc ") for _ in range(r.randrange(0, 900))) for _ in range(30)]
    raw, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])

    def windows():
        return {(t, int(a)) for t1, t2, place, _, _ in suffix_dedup.anchored_runs(raw, at, 40) for x, y, a in zip(t1, t2, place) for t in range(x, y + 1)}

    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 39) for t in texts)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 333)
    assert windows() == whole


@pytest.mark.parametrize(("seed", "length", "hot", "bucket"), [(0, 100, 5000, 40_000), (2, 10, 5000, 40_000), (4, 100, 2, 50), (5, 37, 5, 30)])
def test_removed_bytes_equal_all_windows(spark, monkeypatch, seed, length, hot, bucket):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    passages = [" ".join(r.choice(words) for _ in range(r.randrange(5, 80))) for _ in range(8)]
    rows = [(i, " ".join(r.choice([*[r.choice(words) for _ in range(3)], r.choice(passages)]) for _ in range(r.randrange(0, 40)))) for i in range(60)]
    rows += [(100, "x" * 700), (101, "y" + "x" * 500), (102, None), (103, ""), (5, rows[7][1]), (9, rows[9][1]), (None, rows[3][1]), (None, "q" * 150), (104, "ab" * 400), (3, rows[3][1] * 2)]
    d = spark.createDataFrame([(*x, "k", 1, "s") for x in rows], TEXTS).repartition(3)
    assert sorted((tuple(x) for x in suffix_dedup.report(d, length, shard=16).collect()), key=str) == plain_repeats(rows, length)


def test_a_very_long_text_and_a_hot_line(spark):
    line = "a common line that a third of all documents hold, long enough to be longer than one hundred bytes by far, " * 2
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(1 << 20))
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(150)) + line * (i % 3 == 0) + "".join(r.choice("abcdefgh ") for _ in range(150))) for i in range(600)]
    got = {x["doc_id"]: x for x in suffix_dedup.deduplicated(spark.createDataFrame([*rows, (1000, long), (1001, long[:300_000] + "!" + long[300_000:])], "doc_id long, text string")).collect()}
    assert [len(got[i]["spans"]) for i in (0, 1000)] == [0, 0]
    assert got[1001]["kept"] == b"!"  # what is before and what is after it stands in 1000
    text = dict(rows)
    assert all(bytes(got[i]["kept"]).decode() == text[i].replace(line, "") or len(got[i]["kept"]) < 320 for i in range(3, 600, 3))
    assert all(not got[i]["spans"] for i in range(1, 600, 3))


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.report(none).count() == 0 and vector_codes.report(none).count() == 0
    assert suffix_dedup.report(spark.createDataFrame([], TEXTS)).count() == 0
    nulls = spark.createDataFrame([(1, None, 1, "v", "b", "c")], VECTORS)
    assert hard_negatives.report(nulls).count() == 0 and vector_codes.report(nulls).count() == 0
    assert suffix_dedup.report(spark.createDataFrame([(1, None, "k", 1, "s")], TEXTS)).select(F.sum("n_bytes")).first()[0] == 0
