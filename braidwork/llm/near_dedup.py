"""Near-duplicate classes: weighted DartMinHash signatures, banded joining and an exact check.

A word shingle that a text holds n times weighs 1 + floor(log2 n) there, so a line repeated a hundred times counts,
but doesn't drown the rest. Similarity is the weighted Jaccard index: the sum of the smaller weights over that of
the larger ones.

Every shingle owns a Poisson process of darts in the plane of weight and rank, drawn from hashes of the shingle
alone. The plane is cut into cells of one expected dart: regions [0, 1), [1, 2), [2, 4), ... of the weight axis
times steps of rank. A dart counts for a text if it falls below the shingle's weight there. Darts are spread over
the coordinates of the signature; each keeps the earliest. Two texts agree in a coordinate with probability equal to
their similarity. Only ranks up to about ``k (ln k + 2) / total weight`` are thrown, so the work is linear in
distinct shingles plus k log k.

Stages, as many whatever the data but for the rounds of the two component searches (logarithmic in their diameter):

1. Sign. Texts with equal weighted shingles are one node from here on, however many copies there are.
2. Bands of equal signature parts make buckets. In a bucket, nodes whose whole signatures agree in at least
   ``margin`` standard deviations less than the threshold are joined to the smallest they reach; a bucket hands on
   at most a link a node. Components of these links are coarse groups: no similar pair lies across two.
3. The shingles of the nodes in coarse groups, and of no others, are brought together by group and compared exactly;
   pairs that are connected already are passed over. Components of the exact links are the classes.

Buckets and groups of more than ``block`` nodes are cut into blocks by hash, and every two blocks meet in one task, so
memory is bounded; the time of such a group is quadratic in its different texts, never in copies.

Defined results: null or empty texts have no words and are classes of their own; a text of fewer words than
a shingle is one shingle; repeated rows are members of one class; a class is named by its smallest doc_id
(null if it has none). Further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bits_at, cut, discard, groups, list_array, mixed, only_listed, shingle_hashes, slot_bitmap, span_hashes, text_chunks, unused, word_spans

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9996.
BANDS, ROWS = 20, 5
#: Standard deviations of the share of equal coordinates, at the threshold.
MARGIN = 3.5
#: Nodes, and shingles, of a block of a large bucket or group.
BLOCK_NODES, BLOCK_SHINGLES = 2_000, 2_000_000
SLOTS = 1 << 23


def dart_signature(elements: np.ndarray, row: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """n x k signature. ``elements`` are distinct within a row, weights positive; rows without elements get zeros."""
    weight = np.ones(len(elements)) if weight is None else weight
    total = np.bincount(row, weights=weight, minlength=n)
    out = np.zeros((n, k), dtype=np.uint64)
    todo = total > 0
    limit = np.where(todo, k * (math.log(k) + 2) / np.where(todo, total, 1), 0.0)
    while todo.any():
        own = todo[row]
        r, rank, dart = _darts(elements[own], row[own], weight[own], limit)
        key = r * k + ((dart >> np.uint64(33)) % np.uint64(k)).astype(np.int64)
        first = np.full(n * k, np.inf)
        np.minimum.at(first, key, rank)
        ok = rank == first[key]
        full = np.isfinite(first).reshape(n, k).all(axis=1) & todo
        ok &= full[r]
        out.reshape(-1)[key[ok]] = dart[ok]
        todo &= ~full
        limit = np.where(todo, limit * 2, limit)  # an empty coordinate: throw again, twice as far
    return out


#: P(at most i darts in a cell of one expected dart), i = 0, 1, 2, ...
CELL_COUNTS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _darts(elements: np.ndarray, row: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, rank and name of the darts up to each row's limit, region by region of the weight axis: [0, 1), [1, 2), [2, 4), ..."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low, high, region = 0.0, 1.0, 0
    while len(elements):
        width = high - low
        cells = np.ceil(limit[row] * width).astype(np.int64)
        of = np.repeat(np.arange(len(elements)), cells)
        cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        with np.errstate(over="ignore"):
            seed = mixed(elements[of] + (cell + (region << 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            count = np.searchsorted(CELL_COUNTS, _unit(seed))
            at = np.repeat(np.arange(len(of)), count)
            i = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            name = mixed(seed[at] + (i + 1).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
            place = mixed(name)
        e = of[at]
        rank = (cell[at] + _unit(place)) / width
        hit = rank <= limit[row[e]]
        if low or (weight < 1).any():
            hit &= low + width * _unit(mixed(place)) < weight[e]
        found.append((row[e[hit]], rank[hit], name[hit]))
        more = weight > high
        elements, row, weight = elements[more], row[more], weight[more]
        low, high, region = high, high * 2, region + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))  # type: ignore[return-value]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(signature), b + 1, dtype=np.uint64)
            for j in range(rows):
                h = mixed(h * np.uint64(0xA0761D6478BD642F) + signature[:, b * rows + j])
            out[:, b] = h
    return out


def weighted(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, distinct shingles in order, their rows, weights, 16-byte names of the weighted sets; zeros of an empty one) by chunk."""
    for _, raw, at in text_chunks(column):
        n = len(at) - 1
        starts, ends, row = word_spans(raw, at)
        values, of = shingle_hashes(span_hashes(raw, starts, ends), row, n, k)
        order = np.lexsort((values, of))
        v, r = values[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])])) if len(v) else np.zeros(0, np.int64)
        weight = np.floor(np.log2(np.diff(np.append(first, len(v))))) + 1 if len(v) else np.zeros(0)
        v, r = v[first], r[first]
        names = np.zeros((n, 2), dtype=np.uint64)
        begin = np.searchsorted(r, np.arange(n))
        full = np.flatnonzero(np.bincount(r, minlength=n) > 0)
        if len(full):
            with np.errstate(over="ignore"):
                for i, salt in enumerate((0x1234567887654321, 0x0F1E2D3C4B5A6978)):
                    names[full, i] = np.add.reduceat(mixed((v ^ np.uint64(salt)) * (2 * weight.astype(np.uint64) + np.uint64(1))), begin[full])
        yield n, v, r, weight, names


def numbered(v: np.ndarray, r: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle as many times, numbered, as it weighs, in order within a row; and the rows. The Jaccard index of such plain sets is the weighted one."""
    times = weight.astype(np.int64)
    e = np.repeat(v, times)
    i = np.arange(len(e)) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        e = np.where(i > 0, mixed(e + i.astype(np.uint64)), e)
    r = np.repeat(r, times)
    order = np.lexsort((e, r))
    return e[order], r[order]


def _binary(rows: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Rows of bytes as binaries, null where ``empty``."""
    raw, size = rows.tobytes(), rows.shape[1] * rows.itemsize
    return pa.array([None if e else raw[size * i : size * (i + 1)] for i, e in enumerate(empty)], type=pa.binary())


def _signer(k: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for n, v, r, weight, names in weighted(batch.column(2), k):
                signature = dart_signature(v, r, n, bands * rows, weight)
                size = np.bincount(r, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(done, n) for i in (0, 1)),
                        _binary(names.astype(">u8"), size == 0),
                        pa.array(size.astype(np.int64)),
                        list_array(band_keys(signature, bands, rows).reshape(-1), np.arange(n + 1) * bands),
                        _binary((signature & np.uint64(255)).astype(np.uint8), size == 0),
                    ],
                    names=["doc_id", "h", "node", "n_shingles", "bands", "sketch"],
                )
                done += n

    return sign


def _shingler(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, v, r, weight, names in weighted(batch.column(0), k):
                e, of = numbered(v, r, weight)
                begin = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
                yield pa.RecordBatch.from_arrays([_binary(names.astype(">u8"), np.diff(begin) == 0), list_array(e, begin)], names=["node", "shingles"])

    return shingle


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``links`` (a, b): the smallest node of the component, by minimum of the neighbours and pointer jumping."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = cut(step.join(up, "label").select("node", "was", F.least("label", "above").alias("label")))
        moved = new.where("label != was").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        labels.cut_path = new.cut_path  # type: ignore[attr-defined]
        if not moved:
            discard(edges)
            return labels


def reached(similar: np.ndarray) -> np.ndarray:
    """For each of a stack of graphs (graph, node, node) of booleans: the smallest node that each node is connected with."""
    n = similar.shape[-1]
    label = np.broadcast_to(np.arange(n), similar.shape[:-1]).copy()
    while True:
        near = np.where(similar, label[:, None, :], n).min(axis=2)
        new = np.minimum(label, near)
        new = np.take_along_axis(new, new, axis=1)
        if (new == label).all():
            return label
        label = new


def _bucketed(shared: object, slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, sketch, bands) to a row for each band whose slot is set in the bitmap."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(2)
            of, keys = np.repeat(np.arange(batch.num_rows), np.diff(bands.offsets.to_numpy())), bands.flatten().to_numpy()
            take = np.flatnonzero(bits_at(shared, keys & (slots - 1)))  # type: ignore[arg-type]
            rows = pa.array(of[take])
            yield pa.RecordBatch.from_arrays([pa.array(keys[take]), batch.column(0).take(rows), batch.column(1).take(rows)], names=["bucket", "node", "sketch"])

    return pick


def _sketches(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), k)


def _linker(k: int, agree: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, i, j, node, sketch) in order to links of nodes with the smallest of their bucket that they reach by ``agree`` equal coordinates."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in groups(batches, 3):
            sketch, size = _sketches(rows.column(4), k), np.diff(begin)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for s in np.unique(size[size > 1]).tolist():
                starts = begin[:-1][size == s]
                step = max(1, (4 << 20) // (s * s * k))
                for x in range(0, len(starts), step):
                    at = starts[x : x + step, None] + np.arange(s)
                    own = sketch[at]
                    if s * s * k <= 4 << 20:
                        similar = (own[:, :, None, :] == own[:, None, :, :]).sum(axis=3) >= agree
                    else:
                        similar = np.stack([(own[0] == own[0, i]).sum(axis=1) >= agree for i in range(s)])[None]
                    label = np.take_along_axis(at, reached(similar), axis=1)
                    moved = label != at
                    a.append(at[moved])
                    b.append(label[moved])
            node = rows.column(3)
            take = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([node.take(t) for t in take], names=["a", "b"])

    return link


def _verifier(k: int, agree: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (group, i, j, node, sketch, shingles) in order to exact links, as many as connect what is similar in each."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in groups(batches, 3):
            sketch = _sketches(rows.column(4), k)
            offsets, values = rows.column(5).offsets.to_numpy(), rows.column(5).values.to_numpy()
            a: list[int] = []
            b: list[int] = []
            for x, y in zip(begin[:-1].tolist(), begin[1:].tolist()):
                for i, j in connected(sketch[x:y], [values[offsets[r] : offsets[r + 1]] for r in range(x, y)], agree, threshold):
                    a.append(x + i)
                    b.append(x + j)
            node = rows.column(3)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(t, pa.int64())) for t in (a, b)], names=["a", "b"])

    return verify


def connected(sketch: np.ndarray, sets: list[np.ndarray], agree: int, threshold: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all that are connected; the likeliest are compared first, and none within a part found before."""
    n = len(sets)
    label, out = np.arange(n), []
    length = np.array([len(s) for s in sets])
    sure = max(agree, int(sketch.shape[1] * (1 + threshold) / 2))
    for least in (sure, agree) if n > 2 else (agree,):
        for i in range(n - 1):
            rest = np.arange(i + 1, n)
            rest = rest[label[rest] != label[i]]
            if not len(rest):
                continue
            same = (sketch[rest] == sketch[i]).sum(axis=1)
            fits = np.minimum(length[rest], length[i]) >= threshold * np.maximum(length[rest], length[i])
            ok = (same >= least) & fits
            for j in rest[ok][np.argsort(-same[ok], kind="stable")].tolist():
                if label[i] == label[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= threshold * (length[i] + length[j] - both):
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _blocks(rows: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """``rows`` for each pair (i, j) of blocks that its node takes part in, of ``n`` blocks."""
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    return rows.select("*", F.explode(pairs).alias("p")).select(*keys, "p.i", "p.j", *[c for c in rows.columns if c not in keys])


def placed(docs: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, margin: float = MARGIN, block: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, h (hash of the text), node, class (both null without words), first (doc_id and h of the class's first row), class_size and n_shingles for every row of ``docs`` (doc_id, text)."""
    k = bands * rows
    agree = math.ceil(k * threshold - margin * math.sqrt(k * threshold * (1 - threshold)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    signed = cut(docs.mapInArrow(_signer(shingle, bands, rows), "doc_id long, h long, node binary, n_shingles long, bands array<long>, sketch binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("first")
    nodes = cut(signed.where("node is not null").groupBy("node").agg(first, F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    counts = nodes.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut(counts)
    bitmap = slot_bitmap(buckets, F.col("bucket").bitwiseAND(F.lit(SLOTS - 1)), SLOTS)
    met = nodes.select("node", "sketch", "bands").mapInArrow(_bucketed(bitmap, SLOTS), "bucket long, node binary, sketch binary")
    large = buckets.where(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).alias("blocks"))
    dealt = _blocks(met.join(large, "bucket", "left"), ["bucket"], F.coalesce("blocks", F.lit(1))).drop("blocks")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    coarse = components(dealt.mapInArrow(_linker(k, agree), "a binary, b binary"))

    members = cut(coarse.join(nodes.select("node", "first", "n_shingles", "sketch"), "node"))
    sizes = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / block_shingles)).alias("blocks"))
    asked = members.select(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")).distinct()
    texts = only_listed(docs, "h", asked).join(asked.select(F.col("doc_id").alias("asked"), F.col("h").alias("asked_h")), F.col("doc_id").eqNullSafe(F.col("asked")) & (F.col("h") == F.col("asked_h")), "left_semi")
    sets = texts.select("text").mapInArrow(_shingler(shingle), "node binary, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    units = _blocks(members.select("label", "node", "sketch").join(sizes, "label").join(sets, "node"), ["label"], F.col("blocks")).drop("blocks")
    units = units.select("label", "i", "j", "node", "sketch", "shingles").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    links = components(units.mapInArrow(_verifier(k, agree, threshold), "a binary, b binary"))

    classed = nodes.select("node", "first", "copies").join(links, "node", "left").select("node", "first", "copies", F.coalesce("label", "node").alias("class"))
    named = classed.groupBy("class").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    of = cut(classed.select("node", "class").join(named, "class"))
    discard(buckets, members, coarse, links, nodes)
    known = signed.where("node is not null").select("doc_id", "h", "node", "n_shingles").join(of, "node")
    columns = ["doc_id", "h", "node", "class", "first", "class_size", "n_shingles"]
    none = signed.where("node is null").select("doc_id", "h", "node", F.lit(None).cast("binary").alias("class"), F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h").alias("first"), F.lit(1).cast("long").alias("class_size"), "n_shingles")
    return known.select(*columns).union(none.select(*columns))


def near_duplicates(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, class_id, class_size (rows) and n_shingles (different ones) for every row of ``docs`` (doc_id, text)."""
    return placed(docs, **options).select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_shingles")


def keep_one(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs``, whole, less all of a class but its first: that of the smallest doc_id (rows without one come last), then the smallest hash of the text. Rows without words stay."""
    rows = cut(placed(docs.select("doc_id", "text"), **options).where("node is not null").groupBy("doc_id", "h", "first").agg(F.count("*").alias("n")))
    stays = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h") == F.col("first")
    d, h, n = (unused([*docs.columns, "doc_id", "h"], c) for c in ("d", "h", "n"))
    open_ = rows.where(~F.coalesce(stays, F.col("doc_id").isNull() & F.col("first.doc_id").isNull() & (F.col("h") == F.col("first.h"))) | (F.col("n") > 1)).select(F.col("doc_id").alias(d), F.col("h").alias(h), F.when(F.col("first.h") == F.col("h"), F.when(F.col("doc_id").eqNullSafe(F.col("first.doc_id")), F.col("n"))).alias(n))
    hashed = docs.select("*", F.xxhash64("text").alias(f"{h}_"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(f"{h}_") == F.col(h))
    alone = hashed.join(open_, same, "left_anti").drop(f"{h}_")
    repeated = open_.where(F.col(n) > 1)
    again = only_listed(hashed, f"{h}_", repeated.select(F.col(h).alias(f"{h}_"))).join(repeated, same, "left_semi").dropDuplicates(["doc_id", f"{h}_"]).drop(f"{h}_")
    return alone.unionByName(again)
