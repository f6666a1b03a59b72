"""Bytes covered by strings of a given length that also start earlier, by merging shards' Burrows-Wheeler transforms.

Every window of ``length`` bytes has an anchor: of its grams (short strings of bytes) the one with the smallest hash, the
leftmost of several. Equal windows have equal anchors at equal places, so windows meet by anchor, and consecutive windows
with one anchor travel together as a piece. Pieces whose anchor occurs once in the whole table are left behind by a
bitmap over the counted anchors; copies within the rows that a task holds are marked at once, and only the first travels.

Pieces are dealt to buckets by anchor. In a bucket, a piece is two strings, from its anchor onwards and from its anchor
backwards, as symbols of 16 bytes. Runs of pieces are shards: of each the Burrows-Wheeler transform is built. The
transforms are then merged by refining their interleave: it starts with one shard after the other, and each round deals its
entries by their symbol, stably, so that after h rounds suffixes are in the order of their first h symbols. No suffix is
compared or sorted again. The round in which two neighbours part is their common prefix in symbols; the bytes follow
from the one symbol in which they differ. Windows are equal if their pieces lie in one interval of common prefixes that
are long enough, onwards and backwards; all but the earliest of an interval are marked.

An anchor with more than ``HOT`` different pieces sends its windows one by one, dealt by their own hash.

Defined results: null and empty texts have no bytes; rows without doc_id count as the largest; an occurrence is earlier if
(doc_id, start) is smaller, so equal rows don't remove each other's bytes, and have equal results; rows with one doc_id
and different texts are told apart by a hash of the text; further columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, BYTE_VALUES, CHUNK_BYTES, bits_at, cut, discard, groups, mixed, only_listed, powers, slot_bitmap

LENGTH = 100
#: Bytes of a symbol.
SYMBOL = 16
#: Bits of the bitmap of anchors that occur twice, and of that of hot anchors.
REPEAT_BITS, HOT_BITS = 1 << 28, 1 << 23
#: Different pieces of an anchor beyond which its windows travel alone; pieces of a bucket and of a shard.
HOT, BUCKET, SHARD = 5000, 40_000, 8192
#: Bytes of pieces, and pairs of anchors, that a task holds before it sends them.
HELD_BYTES, HELD_ANCHORS = 48 << 20, 2_000_000
NO_DOC = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)


def gram(length: int) -> int:
    return max(1, 28 * length // 100)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def anchored_runs(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: first and last start, place of the anchor, hashes of its gram and of all bytes of the run. ``at``: offsets of the texts in ``raw``. Works on a stretch at a time, also of one long text."""
    m = gram(length)
    width = length - m + 1
    for x in range(0, len(raw) - length + 1, CHUNK_BYTES):
        sub = raw[x : x + CHUNK_BYTES + length - 1]
        n = len(sub) - length + 1
        lo, hi = int(np.searchsorted(at, x, side="right")) - 1, int(np.searchsorted(at, x + n, side="left"))
        end = np.repeat(at[lo + 1 : hi + 1], np.diff(np.clip(at[lo : hi + 1], x, x + n)))
        ok = np.arange(x + length, x + length + n) <= end
        if not ok.any():
            continue
        with np.errstate(over="ignore"):
            sums = np.zeros(len(sub) + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES[sub] * powers(BASE, len(sub) + 1)[: len(sub)], out=sums[1:])
            shift = powers(BASE_INVERSE, len(sub) + 1)
            grams = mixed((sums[m:] - sums[:-m]) * shift[: len(sub) - m + 1])
        least = sliding_min(grams & ~_LOW | np.arange(len(grams), dtype=np.uint64), width)
        anchor = (least & _LOW).astype(np.int64)
        same = (anchor[1:] == anchor[:-1]) & ok[1:] & ok[:-1]
        first, last = ok.copy(), ok.copy()
        first[1:] &= ~same
        last[:-1] &= ~same
        t1, t2 = np.flatnonzero(first), np.flatnonzero(last)
        place = anchor[t1]
        with np.errstate(over="ignore"):
            content = mixed((sums[t2 + length] - sums[t1]) * shift[t1] + (t2 - t1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        yield t1 + x, t2 + x, place + x, grams[place], content


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """(h, kinds) of the anchors that occur twice at least; kinds: their different pieces, counted task by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            found, times = np.unique(h, return_counts=True)
            with np.errstate(over="ignore"):
                _, one = np.unique(mixed(h + c * np.uint64(0xA0761D6478BD642F)), return_index=True)
            kinds = np.bincount(np.searchsorted(found, h[one]), minlength=len(found))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int64)), pa.array(kinds.astype(np.int64))], ["h", "seen", "kinds"])

        for batch in batches:
            if batch.num_rows:
                held += [(h, c) for _, _, _, h, c in anchored_runs(*_bytes(batch.column(0)), length)]
                if sum(len(h) for h, _ in held) > HELD_ANCHORS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(count, "h long, seen long, kinds long")
    return rows.groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("kinds").alias("kinds")).where("seen > 1").select("h", "kinds")


def merge_spans(begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of an owner that touch or overlap become one; owners are 0, 1, ..."""
    order = np.lexsort((begin, owner))
    begin, end, owner = begin[order], end[order], owner[order]
    step = np.int64(1) << 33
    reach = np.maximum.accumulate(end + owner * step)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] + owner[1:] * step > reach[:-1]
    at = np.flatnonzero(new)
    return begin[at], reach[np.append(at[1:], len(begin)) - 1] - owner[at] * step if len(at) else end, owner[at]


_SENT = pa.schema([("route", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("piece", pa.binary())])


def pieces(docs: DataFrame, repeats: Broadcast[bytes], hot: Broadcast[bytes], length: int) -> DataFrame:
    """Pieces with an anchor that occurs twice. A piece has its anchor's place in the text, the distances ``low`` to ``high`` of its windows' starts before it, and its bytes, the anchor always in one column.

    Rows without bytes are spans that are known already as copies of what the task has sent: ``place`` to ``low``."""
    back = length - gram(length)
    columns = np.arange(-back, length)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            bytes_, route, content, doc, key, place, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((place, doc, content))
            c, d, p = content[order], doc[order], place[order]
            same = np.zeros(len(order), dtype=bool)
            near = np.flatnonzero((c[1:] == c[:-1]) & (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])) + 1
            same[near] = (bytes_[order[near]] == bytes_[order[near - 1]]).all(axis=1)
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            copy = same & ((d != d[head]) | (p != p[head]))
            one, rest = order[~copy], order[copy]
            rest = rest[np.lexsort((doc[rest], key[rest]))]
            other = np.ones(len(rest), dtype=bool)
            other[1:] = (key[rest[1:]] != key[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])
            owner, owners = np.cumsum(other) - 1, rest[other]
            begin, end, owner = merge_spans(place[rest] - high[rest], place[rest] - low[rest] + length, owner)
            k = bytes_.shape[1]
            sent = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.arange(0, (len(one) + 1) * k, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(bytes_[one]))])
            owner = owners[owner]
            both = [(route[one], key[owner]), (doc[one], doc[owner]), (key[one], key[owner]), (place[one], begin), (low[one], end), (high[one], np.zeros_like(begin))]
            return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in both), pa.concat_arrays([sent, pa.nulls(len(owner), pa.binary())])], schema=_SENT)

        for batch in batches:
            if not batch.num_rows:
                continue
            raw, at = _bytes(batch.column(0))
            docs_, keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for t1, t2, a, h, c in anchored_runs(raw, at, length):
                keep = bits_at(repeats, (h % np.uint64(REPEAT_BITS)).astype(np.int64))
                t1, t2, a, h, c = t1[keep], t2[keep], a[keep], h[keep], c[keep]
                alone = bits_at(hot, (h % np.uint64(HOT_BITS)).astype(np.int64))
                if alone.any():
                    times = np.where(alone, t2 - t1 + 1, 1)
                    begin = np.repeat(t1, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    t2, a, h, c, alone = np.where(np.repeat(alone, times), begin, np.repeat(t2, times)), np.repeat(a, times), np.repeat(h, times), np.repeat(c, times), np.repeat(alone, times)
                    t1 = begin
                for s in range(0, len(t1), 20_000):
                    cut_ = slice(s, s + 20_000)
                    b, e, x = t1[cut_], t2[cut_] + length, a[cut_]
                    where = x[:, None] + columns
                    got = raw[np.clip(where, 0, len(raw) - 1)]
                    got[(where < b[:, None]) | (where >= e[:, None])] = 0
                    route, content = h[cut_].view(np.int64), c[cut_].copy()
                    if (own := alone[cut_]).any():
                        with np.errstate(over="ignore"):
                            content[own] = mixed((got[own].astype(np.uint64) * powers(BASE, len(columns))[: len(columns)]).sum(axis=1, dtype=np.uint64) + (x - b)[own].astype(np.uint64))
                        route = np.where(own, content.view(np.int64), route)
                    row = np.searchsorted(at, b, side="right") - 1
                    held.append((got, route, content, docs_[row], keys[row], x - at[row], x - (e - length), x - b))
                    if sum(len(y[0]) for y in held) * len(columns) > HELD_BYTES:
                        yield flush()
        if held:
            yield flush()

    return docs.select("text", "doc", "key").mapInArrow(send, "route long, doc long, key long, place long, low long, high long, piece binary")


def dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].reshape(x.shape)


def symbols(strings: np.ndarray) -> np.ndarray:
    """Ranks of the symbols of strings (rows of bytes, a whole number of symbols), in the order of their bytes, from 1."""
    halves = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    ranks = dense(halves)
    return dense(ranks[:, 0::2] << 32 | ranks[:, 1::2]) + 1


def transform(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of strings of symbols, each with an end 0 after it, and the rank of each whole string among the suffixes. Suffixes of one shard are sorted here, by doubling."""
    n, k = ranks.shape
    suffix = np.zeros((n, k + 1), dtype=np.int64)
    suffix[:, :k] = ranks
    step = 1
    while step <= k:
        after = np.zeros_like(suffix)
        after[:, :-step] = suffix[:, step:]
        suffix = dense(suffix << 32 | after)
        step *= 2
    order = np.argsort((suffix * n + np.arange(n)[:, None]).ravel())
    string, column = order // (k + 1), order % (k + 1)
    whole = np.empty(n, dtype=np.int64)
    at = np.flatnonzero(column == 0)
    whole[string[at]] = at
    return np.where(column == 0, 0, ranks[string, np.maximum(column - 1, 0)]), whole


def interleave(transforms: list[np.ndarray], strings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' transforms: the merged rank of each of their entries, one shard after the other, and of each merged rank the symbols common with the one before (``depth`` + 1 if all are).

    The ends of strings, which come first, always stay in the order of the shards."""
    given = np.concatenate(transforms)
    n, ends = len(given), sum(strings)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(x) for x in transforms])
    home = np.repeat(np.arange(len(transforms), dtype=np.uint16), strings)
    numbers = np.arange(n, dtype=np.uint64)
    entry = np.arange(n)
    parted = np.zeros(n, dtype=bool)
    parted[:1] = True
    common = np.full(n, depth + 1, dtype=np.int64)
    for h in range(1, depth + 2):
        block = np.cumsum(parted)
        dealt = given[entry].astype(np.uint64) << np.uint64(32) | numbers
        dealt.sort()
        order, symbol = (dealt & _LOW).astype(np.int64), dealt >> np.uint64(32)
        shard, block = shard[order], block[order]
        shard[:ends], block[:ends] = home, 0
        fresh = np.zeros(n, dtype=bool)
        fresh[1:] = ((symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])) & ~parted[1:]
        entry = np.empty(n, dtype=np.int64)
        entry[np.argsort(shard, kind="stable")] = np.arange(n)
        if not fresh.any():
            break
        common[fresh] = h - 1
        parted |= fresh
    rank = np.empty(n, dtype=np.int64)
    rank[entry] = np.arange(n)
    return rank, common


def merged_order(strings: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each string in the order of all, and of each place the bytes common with the one before (the first: 0)."""
    width = -(-strings.shape[1] // SYMBOL) * SYMBOL
    padded = np.zeros((len(strings), width), dtype=np.uint8)
    padded[:, : strings.shape[1]] = strings
    ranks = symbols(padded)
    k = ranks.shape[1]
    built = [transform(ranks[i : i + shard]) for i in range(0, len(ranks), shard)]
    rank, common = interleave([b for b, _ in built], [len(w) for _, w in built], k)
    offsets = np.cumsum([0, *[len(b) for b, _ in built]])
    whole = np.concatenate([rank[w + o] for (_, w), o in zip(built, offsets[:-1], strict=True)])
    order = np.argsort(whole)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    alike = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        at = whole[order]
        c = np.minimum(np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1), k)
        inner = np.minimum(c, k - 1)
        cells = padded.reshape(len(padded), k, SYMBOL)
        differ = cells[order[:-1], inner] != cells[order[1:], inner]
        alike[1:] = SYMBOL * inner + np.where(differ.any(axis=1), differ.argmax(axis=1), SYMBOL)
    return place, alike


def later_windows(bytes_: np.ndarray, doc: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, shard: int) -> np.ndarray:
    """Of pieces of a bucket: for each distance of a window's start before the anchor, whether an equal window starts earlier."""
    back = length - gram(length)
    later = np.zeros((len(bytes_), back + 1), dtype=bool)
    onwards, alike_on = merged_order(bytes_[:, back:], shard)
    backwards, alike_back = merged_order(bytes_[:, :back][:, ::-1], shard) if back else (np.zeros(len(bytes_), np.int64), np.zeros(len(bytes_), np.int64))
    by_age = np.lexsort((place, doc))
    doc, place = doc[by_age], place[by_age]
    new = np.ones(len(by_age), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    age = np.cumsum(new)
    onwards, backwards, low, high = onwards[by_age], backwards[by_age], low[by_age], high[by_age]
    for j in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= j) & (j <= high))
        if len(own) < 2:
            continue
        interval = np.cumsum(alike_on < length - j)[onwards[own]] * (len(by_age) + 1) + np.cumsum(alike_back < j)[backwards[own]]
        order = np.argsort(interval, kind="stable")
        i = interval[order]
        first = np.zeros(len(i), dtype=np.int64)
        first[1:] = np.where(i[1:] != i[:-1], np.arange(1, len(i)), 0)
        earliest = age[own[order[np.maximum.accumulate(first)]]]
        later[by_age[own[order]], j] = age[own[order]] > earliest
    return later


def marks(sent: DataFrame, buckets: int, length: int, shard: int = SHARD) -> DataFrame:
    """(doc, key, begin, end) of spans of bytes that are copies, from all pieces."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in groups(batches, 1):
            known = rows.filter(pc.is_null(rows.column(7)))
            out = [(known.column(2).to_numpy(), known.column(3).to_numpy(), known.column(4).to_numpy(), known.column(5).to_numpy())]
            for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                part = rows.slice(b, e - b)
                part = part.filter(pc.is_valid(part.column(7)))
                if part.num_rows < 2:
                    continue
                doc, key, place, low, high = (part.column(i).to_numpy() for i in range(2, 7))
                flat = b"".join(part.column(7).to_pylist())
                later = later_windows(np.frombuffer(flat, dtype=np.uint8).reshape(len(doc), -1), doc, place, low, high, length, shard)
                edge = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (i, first), (_, after) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                out.append((doc[i], key[i], place[i] - after + 1, place[i] - first + length))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc", "key", "begin", "end"])

    bucket = F.pmod(F.xxhash64("route"), F.lit(buckets)).alias("bucket")
    dealt = sent.select(bucket, *sent.columns).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "doc long, key long, begin long, end long")


def deduplicated(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """All rows: doc_id, n_bytes, ``spans``, the maximal runs of bytes that are copies, as (begin, end), ``kept``, the bytes outside them in order (a span may begin or end within a character), and their SHA-256."""
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", body.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"))
    keyed = keyed.withColumn("key", F.xxhash64("doc", "text"))
    counted = cut(anchor_counts(keyed, length))
    repeats = slot_bitmap(counted, F.pmod("h", F.lit(REPEAT_BITS)), REPEAT_BITS)
    hot = slot_bitmap(counted.where(F.col("kinds") > HOT), F.pmod("h", F.lit(HOT_BITS)), HOT_BITS)
    wide = length - gram(length) + 1
    total = counted.agg(F.sum(F.when(F.col("kinds") > HOT, F.col("kinds") * wide).otherwise(F.col("kinds")))).first()[0] or 0  # type: ignore[index]
    found = cut(marks(pieces(keyed, repeats, hot, length), 1 + total // BUCKET, length, shard))
    discard(counted)
    spans = found.groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    listed = only_listed(keyed, "key", found, flag=True)
    hit = listed.where("listed").join(spans, ["doc", "key"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end"))
    binary = F.col("text").cast("binary")
    whole = listed.where("not listed").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<begin:long,end:long>>)").alias("spans"), binary.alias("kept"), F.sha2(binary, 256).alias("kept_sha256"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, b, e in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                begin, end, _ = merge_spans(np.array(b or [], np.int64), np.array(e or [], np.int64), np.zeros(len(b or []), np.int64))
                edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), [{"begin": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)], kept, hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    return whole.unionByName(hit.mapInArrow(strip, f"doc_id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary, kept_sha256 string"))


def report(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Bytes, removed bytes and runs of every text, and the digest of what is left."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return deduplicated(docs, length, shard).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
