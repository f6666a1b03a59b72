"""Product codes of vectors: Lloyd's rounds on integer components, with a tree over the parts and one over the entries.

A vector's components become integers, and it is cut into ``PARTS`` equal consecutive parts; each part position has a
codebook. Rows are kept in blocks of a task's consecutive rows, with one tree a part position over the block's parts: a
node has its box and the sum of its parts. A round sends the codebooks (of a fixed size, whatever the table) to all
blocks. There a tree over the entries meets each tree of parts: from pairs of nodes downwards, an entry node goes from a
node's candidates once its least distance is above the largest distance of another. Where one entry is left, the whole
node is its, by the sum that the node has; leaves with several are decided by exact integer distances, ties to the
lower index. Bounds are integers too, so nothing is decided by rounding. Blocks return counts and sums by entry.

Defined results: rows whose vector is null or has null or non-finite components are dropped; a vector shorter than the
longest one, or than the next multiple of ``PARTS``, counts as having zeros there; rows with one vec_id are all coded, and rows
without one come last when the first entries are chosen; equal entries: the lower index takes all. Squared distances
must fit a long. Further columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, and parts of a leaf of its trees.
BLOCK, LEAF = 4096, 32


def finite(vector: Column) -> Column:
    """True if there is a vector and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


class Tree:
    """A balanced tree over rows of integers: nodes by level, each a range of ``order``, with its box and the sum of its rows."""

    def __init__(self, rows: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(rows))
        edges = [0, len(rows)]
        self.levels = [np.array(edges)]
        while np.diff(edges).max(initial=0) > leaf:
            split = [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = rows[self.order[a:b]]
                widest = int((own.max(axis=0) - own.min(axis=0)).argmax())
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, widest], half)]
                split += [a + half, b]
            edges = split
            self.levels.append(np.array(edges))
        self.rows = rows[self.order]
        self.low = [np.minimum.reduceat(self.rows, e[:-1]) for e in self.levels]
        self.high = [np.maximum.reduceat(self.rows, e[:-1]) for e in self.levels]


def bounds(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distances between points of two boxes, row by row."""
    gap = np.maximum(np.maximum(low2 - high, low - high2), 0)
    far = np.maximum(high2 - low, high - low2)
    return np.einsum("ij,ij->i", gap, gap), np.einsum("ij,ij->i", far, far)


def assign(tree: Tree, sums: np.ndarray, entries: np.ndarray, book: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row in tree order and its squared distance, and counts and sums by entry. ``sums``: running sums of the rows, from 0."""
    n, real = len(tree.rows), len(entries)
    code = np.zeros(n, dtype=np.int64)
    count, total = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=np.int64)
    depth, deepest = 0, len(book.levels) - 1
    node, entry_node, level = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    decided = np.zeros(n, dtype=bool)
    while True:
        low, high = tree.low[depth], tree.high[depth]
        near, far = bounds(low[node], high[node], book.low[level][entry_node], book.high[level][entry_node])
        least = np.full(len(low), np.iinfo(np.int64).max)
        np.minimum.at(least, node, far)
        stay = near <= least[node]
        if level == deepest:
            stay &= book.order[entry_node] < real
        node, entry_node = node[stay], entry_node[stay]
        edges = tree.levels[depth]
        single = (np.bincount(node, minlength=len(low)) == 1)[node] & (level == deepest)
        if single.any():
            own, one = node[single], book.order[entry_node[single]]
            a, b = edges[own], edges[own + 1]
            np.add.at(count, one, b - a)
            np.add.at(total, one, sums[b] - sums[a])
            flat = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
            code[flat], decided[flat] = np.repeat(one, b - a), True
            node, entry_node = node[~single], entry_node[~single]
        if not len(node):
            break
        if level < deepest and (depth == len(tree.levels) - 1 or level <= depth):
            node, entry_node, level = np.repeat(node, 2), np.stack([2 * entry_node, 2 * entry_node + 1], axis=1).ravel(), level + 1
        elif depth < len(tree.levels) - 1:
            node, entry_node, depth = np.stack([2 * node, 2 * node + 1], axis=0).ravel(), np.tile(entry_node, 2), depth + 1
        else:
            break
    if len(node):
        order = np.argsort(node, kind="stable")
        node, entry_node = node[order], entry_node[order]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        edges = tree.levels[depth]
        largest = max(int(np.abs(tree.rows).max()), int(np.abs(entries).max()))
        kind = np.float64 if 4 * largest * largest * entries.shape[1] < 1 << 53 else np.int64  # doubles hold whole numbers of 53 bits
        exact = entries.astype(kind)
        square = (exact * exact).sum(axis=1)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
            a, b = int(edges[node[s]]), int(edges[node[s] + 1])
            own = np.sort(book.order[entry_node[s:e]])
            code[a:b] = own[(square[own] - 2 * (tree.rows[a:b].astype(kind) @ exact[own].T)).argmin(axis=1)]
        rest = np.flatnonzero(~decided)
        count += np.bincount(code[rest], minlength=len(entries))
        by = rest[np.argsort(code[rest], kind="stable")]
        if len(by):
            cuts = np.flatnonzero(np.append(True, np.diff(code[by]) != 0))
            total[code[by[cuts]]] += np.add.reduceat(tree.rows[by], cuts)
    apart = tree.rows - entries[code]
    return code, np.einsum("ij,ij->i", apart, apart), count, total


def packed(array: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each; the first byte says how many."""
    most = int(np.abs(array).max(initial=0))
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([size]) + np.ascontiguousarray(array, dtype=f"<i{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64)


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows with (vec_id, label, vector of integers): their ids and labels, and for each part position the order of the parts in its tree, the parts in that order, and the edges of the tree's levels."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                lists = some.column(2)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                grid = np.zeros((some.num_rows, width), dtype=np.int64)
                grid[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
                step = width // PARTS
                trees = [Tree(grid[:, p * step : (p + 1) * step], LEAF) for p in range(PARTS)]
                many = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                edges = np.concatenate([np.array(len(trees[0].levels))[None], *trees[0].levels])  # of all trees: they depend on the number of rows only
                yield pa.RecordBatch.from_arrays([
                    many(some.column(0)), many(some.column(1)), pa.array([packed(np.stack([t.order for t in trees]))]), pa.array([packed(np.stack([t.rows for t in trees]))]), pa.array([packed(edges)]),
                ], ["vec_id", "label", "order", "parts", "edges"])

    return cut(rows.mapInArrow(build, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, `order` binary, parts binary, edges binary"))


def stored_trees(order: bytes, parts: bytes, edges: bytes, n: int) -> list[Tree]:
    e, orders, rows = unpacked(edges), unpacked(order).reshape(PARTS, n), unpacked(parts).reshape(PARTS, n, -1)
    levels, at = [], 1
    for k in range(int(e[0])):
        levels.append(e[at : at + (1 << k) + 1])
        at += (1 << k) + 1
    out = []
    for p in range(PARTS):
        t = Tree.__new__(Tree)
        t.order, t.rows, t.levels = orders[p], rows[p], levels
        t.low = [np.minimum.reduceat(t.rows, x[:-1]) for x in levels]
        t.high = [np.maximum.reduceat(t.rows, x[:-1]) for x in levels]
        out.append(t)
    return out


def visited(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[dict, list[tuple[np.ndarray, ...]]]]:
    """Each block with the results of ``assign`` by part position."""
    book_trees = [entry_tree(b) for b in books if len(b)]
    for batch in batches:
        for row in batch.to_pylist():
            trees = stored_trees(row["order"], row["parts"], row["edges"], len(row["vec_id"]))
            out = []
            for tree, entries, book in zip(trees, books, book_trees, strict=True):
                sums = np.concatenate([np.zeros((1, tree.rows.shape[1]), np.int64), np.cumsum(tree.rows, axis=0)])
                out.append(assign(tree, sums, entries, book))
            yield row | {"orders": [t.order for t in trees]}, out


def entry_tree(entries: np.ndarray) -> Tree:
    """A tree down to single entries. To make their number a power of two the last one is repeated; the copies are left out where they would be single."""
    size = 1 << (len(entries) - 1).bit_length()
    return Tree(np.concatenate([entries, np.repeat(entries[-1:], size - len(entries), axis=0)]), 1)


def lloyd_round(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry becomes the floor of the mean of its parts, unused ones stay."""
    width = books.shape[2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, parts in visited(batches, books):
            for p, (_, _, c, t) in enumerate(parts):
                count[p] += c
                total[p] += t
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(entry.astype(np.int64)), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

    rows = stored.select("vec_id", "order", "parts", "edges").mapInArrow(work, "part long, entry long, n long, sums array<long>")
    means = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = books.copy()
    for r in means.collect():  # at most PARTS * ENTRIES rows
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code as hexadecimal digits, error) of ``vectors`` (vec_id, label, embedding), and the codebooks (part, entry, component)."""
    kept = vectors.where(finite(F.col("embedding"))).select("vec_id", "label", integers(F.col("embedding"), scale).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0  # type: ignore[index]
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    stored = blocks(kept, width)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    grid = np.zeros((len(first), width), dtype=np.int64)
    for i, r in enumerate(first):
        grid[i, : len(r["v"])] = r["v"]
    books = np.stack(np.split(grid, PARTS, axis=1)) if len(first) else np.zeros((PARTS, 0, width // PARTS), np.int64)
    for _ in range(rounds if len(first) else 0):
        books = lloyd_round(stored, books)
    kinds = {f.name: f.dataType.elementType for f in stored.schema.fields if f.name in ("vec_id", "label")}  # type: ignore[attr-defined]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, parts in visited(batches, books):
            n = len(row["vec_id"])
            code, error = np.zeros((n, PARTS), np.int64), np.zeros(n, np.int64)
            for p, ((c, d, _, _), order) in enumerate(zip(parts, row["orders"], strict=True)):
                code[order, p] = c
                error[order] += d
            digits = max(2, len(f"{max(entries - 1, 0):x}"))
            text = ["".join(f"{x:0{digits}x}" for x in r) for r in code.tolist()]
            yield pa.RecordBatch.from_pydict({"vec_id": row["vec_id"], "label": row["label"], "code": text, "error": error}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("vec_id", to_arrow_type(kinds["vec_id"])), ("label", to_arrow_type(kinds["label"])), ("code", pa.string()), ("error", pa.int64())])
    return stored.mapInArrow(work, f"vec_id {kinds['vec_id'].simpleString()}, label {kinds['label'].simpleString()}, code string, error long"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """Codes with the errors summed by label, and the digest of the codebooks."""
    coded, books = codes(vectors)
    coded = cut(coded)
    by = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
