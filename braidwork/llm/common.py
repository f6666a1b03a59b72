"""What several operators share: table reading, lineage cuts and word hashing in numpy."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Bytes of text that numpy works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: The words of the contracts: runs of anything but these ASCII blanks.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset: a temporary one if Spark is this one process, else a folder in the warehouse."""
    context = spark.sparkContext
    kept = context.getCheckpointDir()
    if kept:
        return kept
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and go on from there: it outlives executors, and is smaller than a checkpoint of rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)  # type: ignore[union-attr]
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # type: ignore[union-attr]


#: Bits of the filter that ``only_listed`` broadcasts: 1 MB, whatever the data.
FILTER_BITS = 1 << 23


def slot_bitmap(listed: DataFrame, slot: Column, bits: int = FILTER_BITS) -> Broadcast[bytes]:
    """A broadcast bitmap of ``bits`` bits, with those set that ``slot`` (0 to bits - 1) has in ``listed``."""
    rows = listed.select((slot + 1).alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    return listed.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def bits_at(shared: Broadcast[bytes], slots: np.ndarray) -> np.ndarray:
    return (np.frombuffer(shared.value, dtype=np.uint8)[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def only_listed(df: DataFrame, key: str, listed: DataFrame, bits: int = FILTER_BITS, flag: bool = False) -> DataFrame:
    """Drop most rows of ``df`` whose ``key`` isn't among those of ``listed``, before a shuffle for the exact join.

    With ``flag`` all rows stay, and the column listed is false for those that would go. One hash a key into a bitmap of fixed size. With many more keys than bits it drops nothing, and nothing else changes."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    shared = slot_bitmap(listed, slot, bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(bits_at(shared, batch.column(batch.num_columns - 1).to_numpy()))
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            yield rest.append_column("listed", hit) if flag else rest.filter(hit)

    return df.select("*", slot.alias(unused(df.columns, "slot"))).mapInArrow(pick, StructType([*df.schema.fields, *[StructField("listed", BooleanType())] * flag]))


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column of that name is there, in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that agree in the first ``keys`` columns, from sorted batches: (rows, where each group begins, and the end). Holds a group and a batch at most."""
    rest: pa.RecordBatch | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        rows = batch if rest is None else rest if batch is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if rows is None:
            return
        new = np.zeros(rows.num_rows, dtype=bool)
        new[0] = True
        for i in range(keys):
            c = rows.column(i)
            differ = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True)
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new)
        end = int(begin[-1]) if batch is not None else rows.num_rows
        if end:
            yield rows.slice(0, end), np.append(begin[begin < end], end)
        rest = rows.slice(end) if batch is not None else None


def word_array(text: Column) -> Column:
    """The words of a text, in order; none of a null text. One class for all blanks, then a split on one character, which needs no regex."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r]", " ")
    return F.array_remove(F.split(flat, " "), "")


def paired(hashes: Column, apart: int) -> Column:
    """Hashes of all pairs (i, i + apart) of an array of longs: windows of twice the width, in one pass and without a slice for each."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_VALUES = seeded(256, 11)
BASE = 0x9E3779B97F4A7C55
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            made = np.cumprod(steps)
        if n > 4 * CHUNK_BYTES:  # of one huge text: not kept
            return made
        _powers[base] = got = made
    return got


def is_blank_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(BLANKS)] = True
    return t


WORD_BYTES = ~is_blank_table()


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows and the end) of runs of rows with about CHUNK_BYTES. Nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(raw: np.ndarray, at: np.ndarray, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and the row of each."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = word_bytes[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values, by prefix sums, then mixed with the length."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[raw] * powers(BASE, len(raw) + 1)[: len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(raw) + 1)[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, row: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of a row, and their rows; a row with fewer words, but some, has one shingle of them all.

    ``words`` and ``row`` are in text order, ``n`` is the number of rows."""
    count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    mult = np.uint64(0xA0761D6478BD642F)
    with np.errstate(over="ignore"):
        if len(words) >= k:
            h = words[: len(words) - k + 1].copy()
            for j in range(1, k):
                h = h * mult + words[j : len(words) - k + 1 + j]
            ok = row[: len(words) - k + 1] == row[k - 1 :]
            full, of = mixed(h[ok]), row[: len(words) - k + 1][ok]
        else:
            full, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            more = []
            for r in short:
                h = np.uint64(count[r])
                for x in words[begin[r] : begin[r + 1]]:
                    h = h * mult + x
                more.append(h)
            full, of = np.concatenate([full, mixed(np.array(more, np.uint64))]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            full, of = full[order], of[order]
    return full, of


def sorted_sets(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, their rows, and where each row begins (n + 1 numbers)."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    return v, r, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n) if len(r) else np.zeros(n, np.int64))])


def list_array(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.astype(np.uint64).view(np.int64)))
