"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents are cut into pieces of at most ``capacity`` tokens; pieces are dealt by a salted hash to shards of about
``SHARD_PIECES``, so a hot source, and rows that are all the same, are spread like any other, and each shard is packed by itself. Pieces go in
order of falling length; bins stand in order of residual capacity; from the tightest bin that can hold the
piece the search goes on to successors until one has neither the piece's source nor its duplicate cluster in
its bitmaps; a new bin is opened only if none has. Texts are not shuffled, only their lengths.

Defined results: null and empty texts have no tokens and come out with a null bin; a null source or cluster
conflicts with nothing; repeated rows are pieces of their own, in different bins unless source and cluster are
null; columns beyond doc_id, text, source and cluster are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, word_array

CAPACITY = 2048
SHARD_PIECES = 2_000


def best_fit(sizes: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, given in packing order; source and cluster are numbers from 0, or -1 for none."""
    n = len(sizes)
    width = [max(1, (int(x.max()) >> 6) + 1) if n else 1 for x in (source, cluster)]
    bits = [np.zeros((n, w), dtype=np.uint64) for w in width]
    residual, order, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0  # of the open bins, by residual
    out = np.empty(n, np.int64)
    bins = 0
    for i in range(n):
        size, at = int(sizes[i]), -1
        k = int(np.searchsorted(residual[:used], size))
        step = 64
        while k < used and at < 0:
            some = order[k : min(k + step, used)]
            free = np.ones(len(some), dtype=bool)
            for b, x in zip(bits, (source[i], cluster[i])):
                if x >= 0:
                    free &= (b[some, x >> 6] >> np.uint64(x & 63) & np.uint64(1)) == 0
            first = int(free.argmax())
            if free[first]:
                at = k + first
            k, step = k + len(some), step * 4
        if at < 0:
            own, left = bins, capacity - size
            bins += 1
        else:
            own, left = int(order[at]), int(residual[at]) - size
            residual[at : used - 1], order[at : used - 1] = residual[at + 1 : used].copy(), order[at + 1 : used].copy()
            used -= 1
        out[i] = own
        for b, x in zip(bits, (source[i], cluster[i])):
            if x >= 0:
                b[own, x >> 6] |= np.uint64(1) << np.uint64(x & 63)
        if left > 0:
            at = int(np.searchsorted(residual[:used], left, side="right"))
            residual[at + 1 : used + 1], order[at + 1 : used + 1] = residual[at:used].copy(), order[at:used].copy()
            residual[at], order[at] = left, own
            used += 1
    return out


def numbered(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, cluster: Column | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id and bin_offset of every piece. ``docs`` has doc_id, text and source; tokens are words.

    ``cluster`` names the duplicate cluster; by default equal texts, letter case apart, are one."""
    named = F.xxhash64(F.lower("text")) if cluster is None else cluster
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(F.col("text").isNotNull(), named).alias("cluster"), F.size(word_array(F.col("text"))).cast("long").alias("n"))
    pieces = whole.select("doc_id", "source", "cluster", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0).cast("long")))).alias("piece")).select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens")
    )
    pieces = cut(pieces.withColumn("salt", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards))).drop("salt")

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
        column = lambda c: group.column(c).combine_chunks()
        sizes = column("n_tokens").to_numpy()
        full = int(np.searchsorted(-sizes, 0))
        bins = best_fit(sizes[:full], numbered(column("source"))[:full], numbered(column("cluster"))[:full], capacity)
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(sizes[:full][order]) - sizes[:full][order]
        start = np.concatenate([[True], np.diff(bins[order]) > 0]) if full else np.zeros(0, bool)
        offset = np.empty(full, np.int64)
        offset[order] = run - np.maximum.accumulate(np.where(start, run, 0))
        named_ = bins + (group.column("shard")[0].as_py() << 24)
        pad = [None] * (len(sizes) - full)
        return pa.table(
            {c: column(c) for c in ("doc_id", "piece", "first_token", "n_tokens")} | {"bin_id": pa.array([*named_.tolist(), *pad], pa.int64()), "bin_offset": pa.array([*offset.tolist(), *pad], pa.int64())}
        )

    return dealt.groupBy("shard").applyInArrow(one, "doc_id long, piece long, first_token long, n_tokens long, bin_id long, bin_offset long")


def bin_rows(packed: DataFrame) -> DataFrame:
    """A row a bin: its documents in order and how full it is. Bounded by the capacity."""
    return packed.where("bin_id is not null").groupBy("bin_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"), F.sum("n_tokens").alias("used"))
