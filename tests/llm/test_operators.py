"""Each operator against brute force, and on nulls, empty texts, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidwork.llm import decontaminate, licenses, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup, tool_calls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, band int"
rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text: str, every: int, seed: int) -> str:
    r, words = random.Random(seed), text.split()
    return " ".join(r.choice(VOCABULARY) if i % every == every - 1 else w for i, w in enumerate(words))


def table(spark, texts):
    rows = [(i, t, "en", f"src{(i or 0) % 3}", 0, "x", "y", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    base, long = prose(200, 1), prose(3000, 2)
    texts = [(0, base), (1, base), (2, edited(base, 60, 5)), (3, edited(base, 3, 6)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, long), (10, long + " tail"), (11, base + "\n" + base + "\n" + base), (None, prose(50, 9)), (12, prose(60, 10)), (12, prose(60, 10)), (13, "x " * 100)]
    texts += [(20 + i, prose(150, 100 + i)) for i in range(10)]
    return table(spark, texts)


def test_statistics_equal_brute_force(docs):
    got = collections.defaultdict(list)
    for r in quality_rules.apply_rules(docs, []).collect():
        got[r["doc_id"]].append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]))
    for r in docs.collect():
        text = r["text"] or ""
        w = WORD.findall(text)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed, not failed) in got[r["doc_id"]]


def test_rules_find_what_is_labelled(spark):
    good, bad = [(i, prose(80, i)) for i in range(120)], [(200 + i, " ".join(w + "###" for w in prose(80, 900 + i).split())) for i in range(120)]
    d = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(d, labels)
    assert rules and all(r.precision >= 0.97 for r in rules)
    kept = {r["doc_id"] for r in quality_rules.keep(d, rules).collect()}
    assert kept == set(range(120))
    assert quality_rules.keep(d, rules).columns == d.columns
    assert quality_rules.learn_rules(d, labels.limit(0)) == []


def weights(text):
    w = WORD.findall(text or "")
    n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (collections.Counter([tuple(w)]) if w else {})
    return {x: 1 + int(np.log2(c)) for x, c in n.items()}


def similarity(a, b):
    return sum(min(a[x], b[x]) for x in a.keys() & b.keys()) / max(1, sum(max(a.get(x, 0), b.get(x, 0)) for x in a.keys() | b.keys()))


def classes(texts):
    """The index of the first of its class, for each text."""
    sets = [weights(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def test_near_duplicates_equal_brute_force(docs):
    given = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    label = classes([t for _, t in given])
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in rows) == sorted((i or -1, given[k][0] or -1) for (i, _), k in zip(given, label))
    size = collections.Counter(label)
    assert sorted(r["class_size"] for r in rows) == sorted(size[k] for k in label)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == sorted(given[k][0] or -1 for k in size)


@pytest.mark.parametrize("block", [4, 2000])
def test_large_groups_equal_brute_force(spark, block):
    """Copies with edits, of a base that is in the table or not, some by the hundred; buckets and groups are cut into blocks or not."""
    texts = []
    for g in range(4):
        base = prose(150 + 40 * g, 60 + g)
        texts += [base] * (g % 2) + [edited(base, 26 + 6 * i, 70 + i) for i in range(14)]
    texts += [prose(60, 300 + i) + "\n" + "\n".join([prose(9, 1)] * 40) for i in range(5)]
    texts += [texts[3]] * 300
    rng.shuffle(texts)
    d = table(spark, list(enumerate(texts)))
    firsts = {t: i for i, t in reversed(list(enumerate(texts)))}
    unique = sorted(firsts.values())
    label = dict(zip(unique, (unique[k] for k in classes([texts[i] for i in unique]))))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(d, block=block).collect()}
    assert got == {i: label[firsts[t]] for i, t in enumerate(texts)}


def test_one_id_with_two_texts_keeps_both(spark):
    d = table(spark, [(1, prose(50, 1)), (1, prose(50, 2)), (2, prose(50, 2) + " end"), (3, prose(50, 3)), (3, prose(50, 3)), (None, prose(50, 4)), (None, prose(50, 4)), (None, prose(50, 5))])
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.keep_one(d).collect())
    assert kept == sorted([(1, prose(50, 1)), (1, prose(50, 2)), (3, prose(50, 3)), (0, prose(50, 4)), (0, prose(50, 5))])


def test_near_duplicates_link_through_a_middle(spark):
    """Both ends are near the middle but not near each other."""
    middle = prose(400, 50).split()
    left, right = middle.copy(), middle.copy()
    for i in range(8):
        left[i * 20 + 3], right[200 + i * 20 + 3] = "left", "right"
    for lo in ((1, 2, 3), (2, 1, 3), (3, 1, 2)):
        d = table(spark, list(zip(lo, (" ".join(left), " ".join(middle), " ".join(right)))))
        assert {r["class_id"] for r in near_dedup.near_duplicates(d).collect()} == {1}


def test_dart_signature_estimates_weighted_similarity():
    r = np.random.default_rng(0)
    e = r.integers(1, 1 << 62, 300).astype(np.uint64)
    wa, wb = r.uniform(0.2, 6, 300), r.uniform(0.2, 6, 300)
    row = np.repeat([0, 1], 300)
    s = near_dedup.dart_signature(np.concatenate([e, e]), row, 2, 2048, np.concatenate([wa, wb]))
    assert abs((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert near_dedup.near_duplicates(none).count() == 0
    assert decontaminate.report(none, items).count() == 0
    assert {r["contaminated"] for r in decontaminate.report(docs, items).collect()} == {False}
    assert substring_dedup.passages(none).count() == 0
    assert packing.pack(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert pii.pseudonymised(none, "k").count() == 0
    assert quality_rules.apply_rules(none, quality_rules.learn_rules(none, labels)).count() == 0
    model = quality_classifier.fit(docs, labels)
    assert {r["score"] for r in quality_classifier.scores(docs, model).collect()} == {0.5}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_contamination_equals_brute_force(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda s: s.translate({k: k + 32 for k in range(65, 91)})
    items = [(1, prose(40, 1)), (2, prose(30, 2) + " " + prose(40, 1)), (3, "short item here"), (3, "short item here"), (4, None), (5, ""), (6, "Éa " * 15), (None, prose(30, 4)), (7, prose(13, 7)), (8, prose(20, 8) * 2)]
    texts = [(1, prose(40, 1).upper()), (2, "a b c " + prose(30, 2)[:120]), (3, "x, SHORT item, here! y"), (4, None), (5, "éa " * 40), (6, "Éa " * 40), (7, prose(200, 3) + " " + prose(13, 7) + " " + prose(2000, 5)), (8, prose(20, 8) * 3), (8, prose(20, 8) * 3), (9, prose(100, 30))]
    windows = {}
    for i, t in items:
        w = word.findall(lower(t or ""))
        for g in [tuple(w)] if 0 < len(w) < 13 else [tuple(w[k : k + 13]) for k in range(len(w) - 12)]:
            if i is not None:
                windows.setdefault(g, set()).add(i)
    want = {}
    for i, t in texts:
        w = word.findall(lower(t or ""))
        hit, own = set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        want[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    d, b = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_words": 60}):  # one automaton, and several with overlapping pieces
        rows = decontaminate.report(d, b, **options).collect()
        assert len(rows) == len(texts)
        assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in want.items() if not x[4]}
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(d, b).collect()}
    assert prose(13, 7) not in cleaned[7] and len(word.findall(cleaned[7])) == want[7][0] - want[7][1]


def test_classifier_learns_and_scores_empty_texts(spark):
    texts = [(i, prose(60, i) if i % 2 else " ".join(w + "$$$" for w in prose(60, i).split())) for i in range(300)] + [(900, None), (901, "")]
    d = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = quality_classifier.fit(d, labels, only=~quality_classifier.held_out())
    rows = quality_classifier.scores(d, model).withColumn("held", quality_classifier.held_out()).collect()
    held = [r for r in rows if r["held"] and r["doc_id"] < 300]
    assert len(rows) == 302 and held and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_passages_cover_shared_text(spark):
    shared = prose(80, 1)
    texts = [(i, prose(100, 10 + i) + " " + (shared if i % 2 else edited(shared, 31, i)) + " " + prose(70, 40 + i)) for i in range(12)] + [(50, prose(300, 77)), (51, None), (52, ""), (None, shared), (53, "x " * 400), (54, "x " * 300), (55, prose(200, 78)), (55, prose(200, 78))]
    rows = substring_dedup.passages(table(spark, texts)).collect()
    seen = {r["doc_id"] for r in rows} | {r["other_id"] for r in rows}
    assert set(range(12)) <= seen and not seen & {50, 51, 52, 55}
    for r in rows:
        if r["doc_id"] < 12:
            assert r["start"] >= 97 and r["end"] <= 184 and r["n_words"] >= 50 and r["identity"] >= 0.8


def test_exact_passages_made_of_common_pieces_are_found(spark):
    left, right = prose(45, 501), prose(45, 502)
    others = [(i, prose(60, 510 + i) + " " + piece + " " + prose(60, 530 + i)) for i, piece in ((1, left), (2, right), (8, left), (9, right))]
    both = [(i, prose(60, 550 + i) + " " + left + " " + right + " " + prose(60, 560 + i)) for i in (5, 6)]
    rows = substring_dedup.passages(table(spark, others + both)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(6, 5)}
    assert any(r["start"] <= 60 and r["end"] >= 150 for r in rows)


def test_periodic_passages_are_found_whole(spark):
    line = " ".join(f"w{i}" for i in range(13)) + " "
    texts = [(1, "x " * 400), (2, "x " * 300), (3, prose(40, 601) + " " + line * 20 + prose(40, 602)), (4, line * 9 + prose(90, 603)), (5, prose(200, 604))]
    rows = substring_dedup.passages(table(spark, texts)).collect()
    longest = collections.defaultdict(int)
    for r in rows:
        longest[r["doc_id"], r["other_id"]] = max(longest[r["doc_id"], r["other_id"]], r["n_words"])
    assert dict(longest) == {(2, 1): 300, (4, 3): 117}


def test_a_chain_is_cut_where_its_parts_are_apart():
    r = np.random.default_rng(5)
    same, inserted, low = r.integers(0, 1 << 40, 120), r.integers(0, 1 << 40, 100), r.integers(0, 1 << 40, 90)
    b = np.concatenate([same[:60], inserted, same[60:]])
    got = substring_dedup.align(same, b, 0, 0, [(0, 0, 60), (60, 160, 60)], 32)
    assert got == [(0, 60, 0, 60, 1.0), (60, 120, 160, 220, 1.0)]
    near = np.insert(low, 40, 7)  # one word more within a long gap
    a, b = np.concatenate([same[:60], np.tile(low, 7), same[60:]]), np.concatenate([same[:60], np.tile(low, 6), near, same[60:]])
    (one,) = substring_dedup.align(a, b, 0, 0, [(0, 0, 60), (690, 691, 60)], 32)
    assert one[:4] == (0, 750, 0, 751) and one[4] > 0.99
    for seed in range(40):  # whatever lies between: each equal stretch of 50 words is in a part, and parts are similar enough
        g = random.Random(seed)
        pieces, i, j = [], 0, 0
        for _ in range(g.randrange(1, 30)):
            n, m, k = g.choice([(g.randrange(1, 90),) * 3, (g.randrange(1, 90), g.randrange(0, 90), 0), (1, 1, 0)])
            pieces.append((i, j, n, m, k))
            i, j = i + n, j + m
        got = substring_dedup.parts(pieces, 50, 0.8)
        for p, q, n, m, k in pieces:
            assert k < 50 or any(s <= p and p + n <= e and t <= q and q + m <= f for s, e, t, f, _ in got)
        assert all(x[4] >= 0.8 - 1e-9 and x[1] - x[0] >= 50 for x in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_similar_passages_without_long_equal_runs_are_found(spark):
    texts = []
    for i in range(30):  # one word in ten differs
        shared = prose(60, 700 + i)
        texts += [(2 * i, prose(70, 740 + i) + " " + shared + " " + prose(70, 780 + i)), (2 * i + 1, prose(50, 820 + i) + " " + edited(shared, 10, i) + " " + prose(60, 860 + i))]
    rows = substring_dedup.passages(table(spark, texts)).collect()
    assert all(r["doc_id"] == r["other_id"] + 1 and r["identity"] >= 0.8 for r in rows)
    assert len({r["other_id"] for r in rows}) >= 15  # a seed is not sure


def spans_of(rows):
    """doc_id -> spans of its passages; those of its first for a copy."""
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start"], r["end"]))
        spans[r["other_id"]].append((r["other_start"], r["other_end"]))
    return spans


def test_every_shared_run_lies_in_a_passage(spark):
    """Brute force over all runs of 50 words of documents put together from common pieces of any length, copies and periodic stretches among them."""
    r = random.Random(8)
    pieces = [prose(n, 500 + i) for i, n in enumerate((30, 45, 45, 55, 60, 80, 120, 49, 50, 51))] + ["la " * 70, "la li " * 40]
    texts = []
    for i in range(40):
        own = [prose(r.randrange(0, 60), 600 + i)]
        for _ in range(r.randrange(1, 4)):
            own += [r.choice(pieces), prose(r.randrange(0, 9), r.randrange(1 << 20))]
        texts.append(" ".join(own))
    texts += [texts[7], texts[7], prose(90, 77), prose(90, 77)]
    got = substring_dedup.passages(table(spark, list(enumerate(texts)))).collect()
    words = [t.split() for t in texts]
    for x in got:
        a, b = words[x["doc_id"]], words[x["other_id"]]
        assert x["doc_id"] > x["other_id"] and 50 <= x["n_words"] == x["end"] - x["start"] and 0 <= x["start"] < x["end"] <= len(a) and 0 <= x["other_start"] < x["other_end"] <= len(b)
        assert x["identity"] < 1 or a[x["start"] : x["end"]] == b[x["other_start"] : x["other_end"]]
    spans, first = spans_of(got), {t: i for i, t in reversed(list(enumerate(texts)))}
    runs = collections.defaultdict(lambda: collections.defaultdict(list))
    for t, i in first.items():
        for p in range(len(words[i]) - 49):
            runs[tuple(words[i][p : p + 50])][i].append(p)
    shared = {run: at for run, at in runs.items() if len(at) > 1}
    assert len(shared) > 100
    for at in shared.values():
        for i, places in at.items():
            assert any(s <= p and p + 50 <= e for p in places for s, e in spans[i]), (i, places)
    pairs = {(x["doc_id"], x["other_id"]) for x in got}
    assert {(40, 7), (41, 7), (43, 42)} <= pairs and not any(x["doc_id"] in (40, 41) and x["other_id"] != 7 for x in got)


def test_a_passage_whose_parts_are_elsewhere_is_found(spark):
    passage = prose(80, 31).split()
    left, right = " ".join(passage[:45]), " ".join(passage[-45:])
    parts = {0: left, 8: left, 1: right, 9: right, 4: " ".join(passage), 5: " ".join(passage)}
    d = table(spark, [(i, f"{prose(40, 800 + i)} {t} {prose(40, 900 + i)}") for i, t in parts.items()])
    assert (5, 4) in {(r["doc_id"], r["other_id"]) for r in substring_dedup.passages(d).collect() if r["n_words"] >= 80}


@pytest.mark.parametrize("gap", [480, 600, 2500])
def test_exact_runs_beside_a_long_gap_are_found(spark, gap):
    run, other = prose(400, 41), prose(400, 42)
    middle = prose(gap, 43)
    changed = edited("more " + middle, 6, 44)
    d = table(spark, [(1, f"{run} {middle} {other}"), (2, f"{run} {changed} {other}")])
    got = substring_dedup.passages(d).collect()
    for lo, hi in ((0, 400), (400 + gap, 800 + gap)):
        assert any(r["other_start"] <= lo and r["other_end"] >= hi for r in got)


def test_similar_passages_recall(spark):
    """Of passages of 60 words, changed at random; the README states the figures."""
    found = {}
    for same in (80, 85, 90, 95):
        r, texts = random.Random(same), []
        for i in range(60):
            words = prose(60, 5000 + 100 * same + i).split()
            n = round(60 * (100 - same) / 100)
            other = words.copy()
            for j in r.sample(range(60), n):
                other[j] = f"new{j}"
            texts += [(2 * i, f"{prose(50, i)} {' '.join(words)} {prose(50, 100 + i)}"), (2 * i + 1, f"{prose(50, 200 + i)} {' '.join(other)} {prose(50, 300 + i)}")]
        got = {(x["other_id"], x["doc_id"]) for x in substring_dedup.passages(table(spark, texts)).collect()}
        found[same] = sum((2 * i, 2 * i + 1) in got for i in range(60)) / 60
    print(found)
    assert found[95] >= 0.95 and found[90] >= 0.9


@pytest.mark.parametrize("pieces", [5, 24])
def test_similar_passages_whose_pieces_are_elsewhere_are_found(spark, pieces):
    """Each piece of at most 18 words of a passage is in further texts, some of which come before and after the two by any order."""
    pairs, others = [], []
    for n in range(12):
        words = prose(80, 6100 + n)
        pairs += [f"{prose(50, 6200 + n)} {words} {prose(50, 6300 + n)}", f"{prose(50, 6400 + n)} {edited(words, 20, n)} {prose(50, 6500 + n)}"]
        others += [f"{prose(30, 100_000 + 10_000 * n + 100 * i + at)} {' '.join(words.split()[at : at + 18])} {prose(30, 300_000 + 10_000 * n + 100 * i + at)}" for i in range(pieces) for at in range(0, 80, 9)]
    got = substring_dedup.passages(table(spark, list(enumerate(pairs + others)))).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(2 * n + 1, 2 * n) for n in range(12)}


def test_a_link_beside_others_of_its_texts_is_found(spark):
    """Four texts in a row, each similar to the next in a passage of its own that holds one line of all: no link is lost for those of the first and the last."""
    line = prose(12, 71)
    parts = [(prose(30, 72 + i), prose(30, 82 + i)) for i in range(3)]
    joint = [f"{a} {line} {b}" for a, b in parts]
    held = [joint[:1], joint[:2], joint[1:], joint[2:]]
    texts = [" ".join([prose(40, 90 + i)] + [f"{edited(x, 24, i)} {prose(40, 100 + 9 * i + j)}" for j, x in enumerate(own)]) for i, own in enumerate(held)]
    d = table(spark, [*enumerate(texts), (9, prose(200, 120)), (10, texts[3])])
    got = {(r["doc_id"], r["other_id"]) for r in substring_dedup.passages(d).collect()}
    assert got >= {(1, 0), (2, 1), (3, 2), (10, 3)}
    rows = {r["doc_id"]: r for r in substring_dedup.classes(d).collect()}
    assert set(rows) == {0, 1, 2, 3, 10} and {r["class_id"] for r in rows.values()} == {0}
    assert [rows[i]["n_links"] for i in (0, 1, 2, 3, 10)] == [sum(i in x for x in got) for i in (0, 1, 2, 3, 10)] and all(r["n_words"] >= 50 for r in rows.values())


@pytest.mark.parametrize("block", [5, 1024])
def test_every_place_of_a_common_seed_can_be_matched(spark, monkeypatch, block):
    """Two texts whose only seeds are in 40 others, where neither is the first nor the last: all passages by brute force over the pairs, block by block."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    line = [word() for _ in range(13)]
    tail = [word() for _ in range(60)]
    changed = [word() if i % 5 == 0 else w for i, w in enumerate(tail)]
    texts = [[*(word() for _ in range(30)), *line, *(word() for _ in range(70))] for _ in range(40)]
    order = sorted(range(42), key=lambda i: i % 7)
    texts = [" ".join(x) for x in [*texts, [*(word() for _ in range(30)), *line, *tail], [*(word() for _ in range(30)), *line, *changed]]]
    d = table(spark, list(enumerate(texts[i] for i in order)))
    pair = tuple(sorted((order.index(40), order.index(41)), reverse=True))
    assert {(x["doc_id"], x["other_id"]) for x in substring_dedup.passages(d, every=True).collect()} == {pair}
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in substring_dedup.classes(d, every=True).collect()} == {i: (pair[1], 1) for i in pair}


def test_every_two_places_meet_once(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 3)
    places = [(h, doc, 10 * h + x, x % 2) for h, n in ((1, 2), (2, 11)) for doc in range(n) for x in range(1 + doc % 3)]
    rows = spark.createDataFrame([(*p, sum(q[0] == p[0] for q in places)) for p in places], "hash long, doc_id long, pos int, more int, n long")
    got = sorted((x["doc_id"], x["other_id"], *x["m"]) for x in substring_dedup._all_met(rows, 6).collect())
    assert got == sorted((a[1], b[1], a[2], b[2], 6 + min(a[3], b[3])) for a in places for b in places if a[0] == b[0] and a[1] > b[1])


def test_extension_crosses_changed_and_skipped_words():
    a = np.arange(40)
    b = np.concatenate([a[:10], [99], a[11:20], a[22:40]])  # one word differs, two are left out
    got = substring_dedup.extended(a, b)
    assert sum(x[2] for x in got) == 40 and sum(x[3] for x in got) == 38 and sum(x[4] for x in got) == 37
    assert substring_dedup.extended(a, a + 100) == [] == substring_dedup.extended(a[:0], a)


def test_extensions_of_many_equal_those_of_one():
    r = np.random.default_rng(1)
    for _ in range(20):
        texts = [[r.integers(0, 5, r.integers(1, 90)).astype(np.int32) for _ in range(9)] for _ in range(2)]
        words, size = [np.concatenate(x) for x in texts], [np.array([len(y) for y in x]) for x in texts]
        begin, at = [np.cumsum(n) - n for n in size], [np.array([r.integers(0, m + 1) for m in n]) for n in size]
        after, before = substring_dedup.extensions(words, begin, at, size, 1, 50), substring_dedup.extensions(words, begin, [x - 1 for x in at], size, -1, 50)
        for k in range(9):
            (a, b), (i, j) = (x[k] for x in texts), (x[k] for x in at)
            for got, pieces in ((after, substring_dedup.extended(a[i : i + 50], b[j : j + 50])), (before, substring_dedup.extended(a[max(i - 50, 0) : i][::-1], b[max(j - 50, 0) : j][::-1]))):
                assert (got[0][k], got[1][k]) == (sum(p[2] for p in pieces), sum(p[3] for p in pieces))


def test_steps_of_many_give_the_pieces_of_one():
    r = np.random.default_rng(2)
    for reach in (50, 16, 61):
        a = [r.integers(0, 4, r.integers(1, 90)).astype(np.int32) for _ in range(40)]
        b = [np.delete(x, r.integers(0, len(x), 2)) if i % 2 else np.where(r.random(len(x)) < 0.1, -1, x).astype(np.int32) for i, x in enumerate(a)]
        size = [np.array([len(y) for y in x]) for x in (a, b)]
        (i, j), gone = ([np.zeros(len(a), np.int64)] * 2, None)
        gone, (pair, *moves) = substring_dedup.steps([np.concatenate(a), np.concatenate(b)], [np.cumsum(n) - n for n in size], [i, j], size, 1, reach)
        for k in range(len(a)):
            own = list(zip(*(x[pair == k].tolist() for x in moves)))
            x, y = a[k][:reach], b[k][:reach]
            pieces = substring_dedup.extended(x, y)
            assert substring_dedup.stepped(x, y, own) == pieces
            assert (gone[0][k], gone[1][k]) == (sum(p[2] for p in pieces), sum(p[3] for p in pieces))


def test_runs_of_many_pairs_equal_those_of_one():
    r = np.random.default_rng(3)
    rows = np.sort(r.integers(0, 30, 400))
    pos, other, more = r.integers(0, 90, 400), r.integers(0, 90, 400), r.integers(6, 12, 400)
    of, *runs = substring_dedup.diagonal_runs(rows, pos, other, more, 6, 8)
    for k in range(30):
        at = rows == k
        want = substring_dedup.diagonal_runs(np.zeros(at.sum(), np.int64), pos[at], other[at], more[at], 6, 8)
        got = list(zip(*(x[of == k].tolist() for x in runs)))
        assert got == list(zip(*(x.tolist() for x in want[1:]))) == sorted(got)


def test_rows_that_are_alone_go_whatever_the_batches():
    r = random.Random(4)
    for _ in range(50):
        values = sorted(r.randrange(40) for _ in range(r.randrange(0, 60)))
        rows = pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(range(len(values)), pa.int32())], names=["hash", "pos"])
        cuts = sorted([0, len(values), *(r.randrange(len(values) + 1) for _ in range(5))])
        got = [x for b in substring_dedup.repeated(rows.slice(x, y - x) for x, y in zip(cuts, cuts[1:])) for x in b.column(1).to_pylist()]
        assert got == [i for i, v in enumerate(values) if values.count(v) > 1]


def test_seeds_and_words_of_spans_are_shuffled_once(spark, monkeypatch):
    plans, written = [], substring_dedup.cut
    monkeypatch.setattr(substring_dedup, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), written(df))[1])
    texts = [(i, f"{prose(40, 200 + i)} {prose(60, 301 + i // 2)} {prose(40, 400 + i)}") for i in range(6)]
    got = substring_dedup.passages(table(spark, texts)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(1, 0), (3, 2), (5, 4)}
    joins = [[line for line in plan.splitlines() if "Join" in line] for plan in plans]
    assert any(joins) and not [x for own in joins[:4] for x in own if "hash#" in x]  # texts, seeds, chains, passages: a join of seeds would shuffle them again
    assert not [x for own in joins for x in own if " p#" in x or "(p#" in x]  # as would one of a span's words with those of the other side


def test_chains_rise_in_both_texts():
    for seed in range(30):
        r = random.Random(seed)
        runs = sorted({(r.randrange(300), r.randrange(300), r.randrange(8, 30)) for _ in range(r.randrange(1, 25))})
        made = substring_dedup.chains(runs)
        assert sorted(x for c in made for x in c) == runs
        for c in made:
            for a, b in zip(c, c[1:]):
                assert a[0] + a[2] <= b[0] + substring_dedup.K - 1 and a[1] + a[2] <= b[1] + substring_dedup.K - 1


def test_packing_respects_capacity_and_conflicts(docs):
    rows = packing.pack(docs, capacity=256, shard_pieces=8).collect()
    n = {}
    for r in docs.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + len(WORD.findall(r["text"] or ""))
    got = collections.Counter()
    bins = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            bins[r["bin_id"]].append(r)
    assert got == n
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in own] == list(np.cumsum([0] + [r["n_tokens"] for r in own])[:-1]) and sum(r["n_tokens"] for r in own) <= 256
        assert len({source[r["doc_id"]] for r in own}) == len(own)


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.best_fit(np.array([8, 6, 5, 4, 2]), np.array([0, 1, 0, 2, 3]), np.full(5, -1), 10).tolist() == [0, 1, 2, 1, 0]
    assert packing.best_fit(np.array([8, 6, 2]), np.array([0, 1, 0]), np.full(3, -1), 10).tolist() == [0, 1, 1]
    assert packing.best_fit(np.array([5, 5]), np.array([0, 1]), np.array([4, 4]), 10).tolist() == [0, 1]


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    card = "4111 1111 1111 1111"
    texts = [(1, f"pay {card} now"), (2, f"{card}."), (3, "not 4111 1111 1111 1112 valid"), (4, "on 2024-02-29 and 2023-02-29, 31/12/1999"), (5, "ip 10.0.0.255 or 300.1.1.1"), (6, "call +1 (017) 555-7713!!"), (7, "a.b+c@x.example.com"), (8, None), (9, ""), (10, "ssn 123-45-6789 é"), (11, "no data"), (12, "v1.2.3 2024 100,000")]
    rows = {r["doc_id"]: r for r in pii.pseudonymised(table(spark, texts), "k").collect()}
    t = {i: rows[i]["text"] for i in rows}
    new = re.search(r"pay (.*) now", t[1])[1]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", new) and new != card and luhn(new.replace(" ", "")) and t[2] == f"{new}."
    assert t[3] == texts[2][1] and t[8] is None and t[9] == "" and t[11] == "no data" and t[12] == texts[11][1]
    assert re.fullmatch(r"on \d{4}-\d{2}-\d{2} and 2023-02-29, \d{2}/\d{2}/\d{4}", t[4]) and "2024-02-29" not in t[4]
    assert re.fullmatch(r"ip \d+\.\d+\.\d+\.\d+ or 300\.1\.1\.1", t[5]) and "10.0.0.255" not in t[5]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}!!", t[6]) and "555-7713" not in t[6]
    assert t[7].endswith("@x.example.com") and "a.b+c" not in t[7] and re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} é", t[10])
    assert [rows[i]["n_found"] for i in (1, 3, 4, 5, 8, 11)] == [1, 0, 2, 1, 0, 0]
    assert set(docs_columns(rows[1])) >= {"lang", "source", "row", "node"}


def docs_columns(row):
    return row.asDict().keys()


def test_feistel_is_a_permutation(spark):
    a, b = F.lit(7).cast("long"), F.lit(13).cast("long")
    got = [r[0] for r in spark.range(91).select(pii.feistel(F.col("id"), a, b, "k", "t")).collect()]
    assert sorted(got) == list(range(91)) and got != list(range(91))


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    texts = [(1, "x y\nReleased under the MIT License.\nz"), (2, prose(300, 1) + " " + mit + " " + prose(300, 2)), (3, "released under another license"), (4, None), (5, ""), (6, "THIS WORK is licensed under the GNU General Public License, version 3!"), (7, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (8, "MIT"), (1, "x y\nReleased under the MIT License.\nz")]
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(table(spark, texts)).collect())
    assert got == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (6, "GPL-3.0"), (7, "Apache-2.0"), (7, "CC-BY-NC-4.0")]


def test_tool_calls(spark):
    kinds = "conv_id long, call_id string, turn int, name string, arguments string, depends_on array<string>"
    calls = [
        (1, "a", 1, "search", '{"query": "q", "limit": 3}', []), (1, "b", 2, "translate", '{"text": "t", "strict": "no"}', ["a"]), (1, "c", 3, "measure", '{"words": 1.5, "z": 1}', ["a", "b", "gone"]),
        (1, "d", 4, "search", "[1]", ["e"]), (1, "e", 5, "other", "{}", ["d"]), (1, "f", 6, "search", None, ["e"]), (2, "a", 1, "search", '{"limit": 1}', None), (2, "a", 1, "search", '{"limit": 1}', None), (None, "a", 1, "measure", '{"words": 2}', []), (3, "x", 0, None, "", []),
    ]
    results = [(1, "a", 2, 'say "hi"\n'), (1, "a", 9, "later"), (1, "zz", 3, "orphan"), (2, "a", 5, None), (None, "a", 1, "no")]
    c, r = spark.createDataFrame(calls, kinds), spark.createDataFrame(results, "conv_id long, call_id string, turn int, content string")
    got = {(x["conv_id"], x["call_id"]): x for x in tool_calls.link(c, r, tool_calls.SCHEMAS).collect()}
    assert len(got) == 9
    assert [got[1, k]["level"] for k in "abcdef"] == [0, 1, 2, None, None, None]
    assert got[1, "a"]["valid"] and got[1, "a"]["json"] == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search","result":"say \\"hi\\"\\n"}'
    assert got[1, "b"]["problems"] == "strict is no boolean" and got[1, "c"]["problems"] == "unknown z" and got[1, "c"]["missing"] == 1
    assert got[1, "d"]["problems"] == "not an object" and got[1, "e"]["problems"] == "unknown tool" and got[1, "f"]["problems"] == "not an object"
    assert got[2, "a"]["problems"] == "missing query" and got[2, "a"]["result_turn"] == 5 and got[None, "a"]["valid"] and got[None, "a"]["level"] == 0
    assert got[3, "x"]["problems"] == "not an object"
    assert {(o["conv_id"], o["n_orphans"]) for o in tool_calls.orphans(c, r).where("conv_id is not null").collect()} == {(1, 1)}


def test_archives_round_trip(spark):
    big = "<p>" + "é" * 60 + "</p>"
    pages = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 20), (1, "http://b", big)]
    rows = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    want = collections.Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = h == big and i != 1
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None] += 1
    assert got == want
    assert len({(r["archive"], r["offset"]) for r in rows}) == len(rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = prose(40, 70)
    texts = [(i, prose(120, 200 + i)) for i in range(60)] + [(100 + i, " ".join(w + "###" for w in prose(120, 300 + i).split())) for i in range(60)]
    texts += [(61, prose(120, 200)), (62, prose(80, 80) + " " + item), (63, prose(118, 81) + " 4111111111111111 end"), (64, "tiny"), (65, None)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i, _ in texts if i < 60 or i >= 100], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(60)) | {63}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert "4111111111111111" not in docs.where("doc_id = 63").first()["text"]
