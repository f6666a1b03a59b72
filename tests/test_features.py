"""The default embedder, token counts and names in searches."""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidwork.functions import embedding, tokens
from braidwork.operators import conversation, search

FILES = "/opt/tokenizers"
TEXTS = {1: "Release notes, Über-naïve notes", 2: "notes of the RELEASE", 3: "the weather", 4: "", 5: None, 6: "?!", 7: "long " * 40_000 + "z" * 20_000, 8: "notes of the release"}


def plain(texts, weighted):
    """{id: vector} word by word."""
    xxhash = pytest.importorskip("xxhash")

    def features(text):
        words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
        return Counter(f for w in words for f in [w, *(f"<{w}>"[i : i + 3] for i in range(len(w)))])

    signed = lambda f: (h := xxhash.xxh64_intdigest(f, 42)) - (1 << 64 if h >> 63 else 0)
    known = {k: features(v) for k, v in texts.items() if v is not None}
    df = Counter(b for fs in known.values() for b in {signed(f) % embedding.BUCKETS for f in fs})
    out = {}
    for k, fs in known.items():
        v = [0] * embedding.SIZE
        for f, n in fs.items():
            h = signed(f)
            w = round((math.log((len(known) + 1) / (df[h % embedding.BUCKETS] + 1)) + 1) * embedding.ONE) if weighted else embedding.ONE
            v[(h >> 20) % embedding.SIZE] += (1 if not h & (1 << 17) else -1) * n * w
        length = math.sqrt(sum(x * x for x in v))
        out[k] = [x / length if length else 0.0 for x in v]
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_embedder_equals_a_plain_one(spark, weighted):
    docs = spark.createDataFrame([*TEXTS.items(), (None, "x")], "message_id long, text string").repartition(3)
    got = embedding.embedded(docs, "message_id", embedding.weights(docs, "message_id") if weighted else None)
    have = {r["message_id"]: r["embedding"] for r in got.collect()}
    want = plain(TEXTS, weighted)
    assert set(have) == set(TEXTS) and have[5] is None
    for k, v in want.items():
        assert have[k] == pytest.approx(v, abs=1e-6)
    near = search.knn(got.where("embedding is not null and message_id <> 4 and message_id <> 6"), [float(x) for x in have[8]], 2, key="message_id").collect()
    assert [r["doc"] for r in near] == [2, 8] and have[2] == have[8]
    assert embedding.embedded(docs.limit(0), "message_id").count() == 0


@pytest.mark.skipif(not os.path.isdir(FILES), reason="no vocabularies")
def test_token_counts(spark):
    import importlib.util

    tiktoken = pytest.importorskip("tiktoken")
    found = importlib.util.spec_from_file_location("public_tokenizers", f"{FILES}/__init__.py")
    public = importlib.util.module_from_spec(found)
    found.loader.exec_module(public)
    with open(f"{FILES}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {**TEXTS, 9: "<|endoftext|> don't  stop\n\n", 10: "日本 😀"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = tokens.counted(docs, "text", f"{FILES}/byte_bpe_50k.json", at_once=3)
    assert {r["id"]: r["tokens"] for r in got.collect()} == {k: None if v is None else len(other.encode_ordinary(v)) for k, v in texts.items()}
    walked = conversation.time_aligned_batches(got.withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("c", F.lit(1)), "c", "at", "tokens", 50, "id")
    assert walked.count() == len(texts)


def test_names_in_searches(spark):
    docs = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 3, 11), (4, None, None)], "message_id long, author_archive_id long, sid long")
    persons = spark.createDataFrame([(1, "acme[V]agent_dana"), (2, "Acme_Robin"), (3, "acme_dana"), (4, None)], "im_archiveid long, username string")
    channels = spark.createDataFrame([(10, "Ops"), (11, "ops"), (12, None)], "sid long, name string")
    found = lambda *a: sorted(r[0] for r in search.named(docs, *a).select("message_id").collect())
    assert found({"from": ["DANA"], "in": []}, persons, channels) == [1, 3]
    assert found({"from": ["robin", "acme_dana"]}, persons, channels) == [2, 3]
    assert found({"from": [], "in": ["OPS"]}, persons, channels) == [1, 2, 3]
    assert found({"from": ["robin"], "in": ["nowhere"]}, persons, channels) == [] == found({"from": ["nobody"]}, persons)
    assert found({"from": ["robin"]}) == [1, 2, 3, 4] == found({}, persons, channels)
