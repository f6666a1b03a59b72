"""The default embedder: signed hashing of words and their character trigrams into a unit vector, weighted by rarity.

It needs no model, and a text has the same vector whatever else is embedded with it, given the same weights. All sums are
of whole numbers, so no order of rows or tasks changes a bit. Words are counted before their trigrams are made, so a long
text costs its different words; a row becomes its ``SIZE`` sums, or its buckets, before it is shuffled. A null text has a null vector, one
without a word a vector of zeros; rows that share a key count as one text; null keys take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tokens

SIZE = 384
#: Weights are kept by bucket of features, so there are as many whatever the corpus, and they are broadcast.
BUCKETS = 1 << 16
#: A weight of 1.
ONE = 1 << 20
#: Words that are worked on at once, unless a text has more.
WORDS = 1 << 17

Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _hashes(word: str) -> np.ndarray:
    """Of a word and of its trigrams, those of Spark's ``xxhash64``."""
    marked = f"<{word}>"
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in (word, *(marked[i : i + 3] for i in range(len(word))))], np.uint64).view(np.int64)


_of_short = lru_cache(maxsize=1 << 16)(_hashes)


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row and number of rows of a part of the texts, which are lists of words, and (row in the part, hash, n) of its features."""
    size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, end = texts.flatten(), np.cumsum(size)
    first = 0
    while first < len(texts):
        start = end[first] - size[first]
        last = max(int(np.searchsorted(end, start + WORDS, "right")), first + 1)
        words = flat.slice(start, end[last - 1] - start).dictionary_encode()
        known = words.dictionary.to_pylist()
        codes = np.repeat(np.arange(last - first), size[first:last]) * max(len(known), 1) + words.indices.to_numpy().astype(np.int64)
        pairs, n = np.unique(codes, return_counts=True)
        row, word = np.divmod(pairs, max(len(known), 1))
        hashes = [_of_short(w) if len(w) <= 32 else _hashes(w) for w in known]
        count = np.array([len(h) for h in hashes], np.int64)
        begin = np.cumsum(count) - count
        many = count[word]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        h = np.concatenate([*hashes, np.zeros(0, np.int64)])[np.repeat(begin[word], many) + within]
        yield first, last - first, np.repeat(row, many), h, np.repeat(n, many)
        first = last


def _lists(values: np.ndarray, size: np.ndarray, kind: pa.DataType, null: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind), mask=None if null is None else pa.array(null))


def _by_key(rows: DataFrame, read: Reader, schema: str, merge: Reader, merged: str) -> DataFrame:
    """``read`` of the rows, then ``merge`` of what it gives, with the rows of a key in a row."""
    key = rows.columns[0]
    return rows.mapInArrow(read, schema).repartition(key).sortWithinPartitions(key).mapInArrow(merge, merged)


def _groups(keys: pa.Array) -> np.ndarray:
    """Where each key begins."""
    return np.concatenate([[0], np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, buckets) of each row."""
    for batch in batches:
        for first, n, row, h, _ in _features(batch.column(1)):
            row, bucket = np.divmod(np.unique(row * BUCKETS + h % BUCKETS), BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), _lists(bucket, np.bincount(row, minlength=n), pa.int32())], names=["key", "buckets"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, df) of the keys of a task. The last key of a batch may go on in the next."""
    df, held = np.zeros(BUCKETS, np.int64), (None, np.zeros(0, np.int64))
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, lists = batch.column(0), batch.column(1)
        begin = _groups(keys)
        size = np.diff(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])[np.concatenate([begin, [len(keys)]])])
        pairs = np.repeat(np.arange(len(begin)), size) * BUCKETS + lists.flatten().to_numpy()
        if keys[0] == held[0]:
            pairs = np.concatenate([held[1], pairs])  # as of group 0
        else:
            df[held[1]] += 1
        group, bucket = np.divmod(np.unique(pairs), BUCKETS)
        last = group == len(begin) - 1
        df += np.bincount(bucket[~last], minlength=BUCKETS)
        held = (keys[len(keys) - 1], bucket[last])
    df[held[1]] += 1
    bucket = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(df[bucket])], names=["bucket", "df"])


def weights(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(bucket, weight) for ``BUCKETS`` buckets: ln((texts + 1) / (texts with it + 1)) + 1, in parts of ``ONE``."""
    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    n = known.select(key).distinct().count()
    words = known.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words"))
    kind = docs.schema[key].dataType.simpleString()
    found = _by_key(words, _buckets, f"key {kind}, buckets array<int>", _counted, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    rarity = F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    return docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(found, "bucket", "left").select("bucket", F.round(rarity * ONE).cast("long").alias("weight"))


def _summed(weight: Callable[[], np.ndarray]) -> Reader:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, sums) of each row; null for a null text."""
        by_bucket = weight()
        for batch in batches:
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for first, n, row, h, times in _features(batch.column(1)):
                value = np.where(h & (1 << 17) == 0, times, -times) * by_bucket[h % BUCKETS]
                sums = np.zeros(n * SIZE, np.int64)
                np.add.at(sums, row * SIZE + (h >> 20) % SIZE, value)
                own = null[first : first + n]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), _lists(sums.reshape(n, SIZE)[~own].ravel(), np.where(own, 0, SIZE), pa.int64(), own)], names=["key", "sums"])

    return read


def _vectors(keys: pa.Array, sums: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    raw = sums.astype(float)
    length = np.sqrt(np.cumsum(raw * raw, axis=1)[:, -1:])  # one after the other
    unit = np.divide(raw, length, out=np.zeros_like(raw), where=length > 0).astype(np.float32)
    return pa.RecordBatch.from_arrays([keys, _lists(unit[known].ravel(), np.where(known, SIZE, 0), pa.float32(), ~known)], names=["key", "embedding"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, embedding). The last key of a batch may go on in the next."""
    held: tuple[pa.Array, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, known = batch.column(0), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        sums = np.zeros((len(keys), SIZE), np.int64)
        sums[known] = batch.column(1).flatten().to_numpy().reshape(-1, SIZE)
        if held is not None:
            keys, sums, known = pa.concat_arrays([held[0], keys]), np.concatenate([held[1], sums]), np.concatenate([held[2], known])
        begin = _groups(keys)
        keys, sums, known = keys.take(pa.array(begin)), np.add.reduceat(sums, begin, axis=0), np.logical_or.reduceat(known, begin)
        if len(begin) > 1:
            yield _vectors(keys.slice(0, len(begin) - 1), sums[:-1], known[:-1])
        held = keys.slice(len(begin) - 1), sums[-1:], known[-1:]
    if held is not None:
        yield _vectors(*held)


def embedded(docs: DataFrame, key: str, weighted: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(key, embedding): ``SIZE`` floats of length one. Without weights all features count alike. Weights are read when this is called."""
    by_bucket = np.full(BUCKETS, ONE, np.int64)
    if weighted is not None:
        by_bucket[:] = 0
        for bucket, weight in weighted.select("bucket", "weight").where("weight is not null").collect():  # BUCKETS at most
            by_bucket[bucket] = weight
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket)
    words = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), tokens(F.col(text)).alias("words"))
    kind = docs.schema[key].dataType.simpleString()
    return _by_key(words, _summed(lambda: shared.value), f"key {kind}, sums array<bigint>", _united, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)
