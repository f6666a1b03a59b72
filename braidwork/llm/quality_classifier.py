"""A text classifier over supervised subword embeddings, trained by numpy stochastic gradient descent.

The features of a text are its words, the character n-grams inside them (of UTF-8 bytes, so a letter beyond ASCII counts as two or three, with one blank as boundary) and pairs of
neighbouring words, hashed into buckets; a bucket has a learned vector; a text is the mean of its features'
vectors, then softmax. Since mean and output layer are linear, scoring needs one number a bucket, of bounded
size, and one pass over the text in numpy; nothing is shuffled.

Defined results: a null or empty text has no feature and gets the score of the intercept; repeated rows each get
their score; without labels of both kinds every score is 0.5; further columns, also the labels', are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, BASE, BYTE_VALUES, mixed, powers, span_hashes, text_chunks, word_spans

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)


def features(raw: np.ndarray, at: np.ndarray, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts in ``raw``, and their rows."""
    starts, ends, row = word_spans(raw, at)
    words = span_hashes(raw, starts, ends)
    mask = np.uint64(buckets - 1)
    out, of = [(words & mask).astype(np.int32)], [row.astype(np.int32)]
    with np.errstate(over="ignore"):
        if len(words) > 1:
            same = row[1:] == row[:-1]
            pair = np.where(words[1:] == words[:-1], np.uint64(1), words[:-1] * np.uint64(3) + words[1:])
            out.append((mixed(pair[same]) & mask).astype(np.int32))
            of.append(row[1:][same].astype(np.int32))
        if len(raw):
            owner = np.zeros(len(raw) + 1, dtype=np.int32)
            inner = at[1:-1][at[1:-1] < len(raw)]
            np.add.at(owner, inner, 1)
            owner = np.cumsum(owner)[:-1].astype(np.int32)
            values = BYTE_VALUES[raw]
            blank = ~WORD_BYTES[raw]
            for n in grams:
                m = len(raw) - n + 1
                if m < 1:
                    continue
                h = values[:m] * powers(BASE, n)[n - 1]
                for j in range(1, n):
                    h = h + values[j : m + j] * powers(BASE, n)[n - 1 - j]
                ok = owner[:m] == owner[n - 1 :]
                if n > 2:
                    for j in range(1, n - 1):
                        ok &= ~blank[j : m + j]
                out.append((mixed(h[ok] + np.uint64(n)) >> np.uint64(20) & mask).astype(np.int32))
                of.append(owner[:m][ok])
    return np.concatenate(out), np.concatenate(of)


def counted(raw: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and share of a row's features, for each (row, bucket) in order."""
    f, row = features(raw, at, buckets)
    key, n = np.unique(row.astype(np.int64) * buckets + f, return_counts=True)
    r = key // buckets
    total = np.bincount(r, weights=n, minlength=len(at) - 1)
    return r, (key % buckets).astype(np.int32), (n / total[r]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """log-odds of label 1 = intercept + mean of ``weight`` over the features."""

    weight: np.ndarray
    intercept: float


def train(begin: np.ndarray, bucket: np.ndarray, share: np.ndarray, label: np.ndarray, *, buckets: int = BUCKETS, size: int = 8, epochs: int = 12, batch: int = 32, rate: float = 0.3, seed: int = 5) -> Model:
    """Softmax over mean vectors; steps are scaled by each parameter's gradients so far."""
    n = len(label)
    if n == 0 or label.min() == label.max():
        return Model(np.zeros(buckets, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (buckets, size)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (size, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_o, seen_b = (np.full_like(x, 1e-6) for x in (vectors, out, bias))
    scale = 30.0  # mean vectors are small, as most features are shared by all texts
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            docs = order[k : k + batch]
            parts = [np.arange(begin[d], begin[d + 1]) for d in docs]
            ix = np.concatenate(parts)
            if not len(ix):
                continue
            of = np.repeat(np.arange(len(docs)), [len(p) for p in parts])
            b, s = bucket[ix], share[ix] * scale
            mean = np.stack([np.bincount(of, weights=vectors[b, j] * s, minlength=len(docs)) for j in range(size)], axis=1)
            z = mean @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), label[docs]] -= 1
            p /= len(docs)
            g_out, g_bias, g_mean = mean.T @ p, p.sum(axis=0), p @ out.T
            used, inverse = np.unique(b, return_inverse=True)
            g_v = np.stack([np.bincount(inverse, weights=g_mean[of, j] * s, minlength=len(used)) for j in range(size)], axis=1)
            seen_v[used] += g_v**2
            vectors[used] -= rate * g_v / np.sqrt(seen_v[used])
            seen_o += g_out**2
            out -= rate * g_out / np.sqrt(seen_o)
            seen_b += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_b)
    return Model((scale * (vectors @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", only: Column | None = None, max_fit_rows: int = 4_000, buckets: int = BUCKETS, **options: float) -> Model:
    """Learn ``label`` of ``labels`` (doc_id, label) from the texts of ``docs`` (doc_id, text).

    Learns from at most about ``max_fit_rows`` labelled rows (with ``only``, a condition on doc_id), those whose
    hashed doc_id comes first: that bounds what is broadcast to reach their texts, and what reaches the driver to
    be trained on, at most ``buckets`` numbers a row."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("doc_id is not null and _y in (0, 1)")
    marked = marked if only is None else marked.where(only)
    marked = marked.groupBy(F.col("doc_id").alias("_id")).agg(F.max("_y").alias("_y"))
    n = marked.count()
    if n > max_fit_rows:
        marked = marked.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1_000_000)) < int(max_fit_rows * 1e6 / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, at in text_chunks(batch.column(2)):
                n = len(at) - 1
                r, b, s = counted(raw, at, buckets)
                begin = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, n) for i in (0, 1)), pa.ListArray.from_arrays(pa.array(begin), pa.array(b)), pa.ListArray.from_arrays(pa.array(begin), pa.array(s))], names=["id", "y", "bucket", "share"]
                )

    got = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("_id")).select(F.col("_id").alias("id"), "_y", "text")
    table = got.mapInArrow(count, "id long, y int, bucket array<int>, share array<float>").toArrow().sort_by("id")
    lists = [table.column(c).combine_chunks() for c in ("bucket", "share")]
    lists = [x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in lists] if len(table) else [pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.float32()))]
    begin = lists[0].offsets.to_numpy()
    return train(begin - begin[0], lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), table.column("y").to_numpy().astype(np.int64), buckets=buckets, **options)  # type: ignore[arg-type]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id and score, the probability of label 1."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(shared), "doc_id long, score double")


def _scorer(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(shared.value)  # type: ignore[attr-defined]
        for batch in batches:
            out = np.full(batch.num_rows, model.intercept)
            for first, raw, at in text_chunks(batch.column(1)):
                f, row = features(raw, at, len(model.weight))
                n = len(at) - 1
                total = np.bincount(row, minlength=n)
                out[first : first + n] += np.bincount(row, weights=model.weight[f], minlength=n) / np.maximum(total, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))], names=["doc_id", "score"])

    return score


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
