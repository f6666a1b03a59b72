"""Hard negatives of anchors, by length buckets with sorted coordinate lists.

Rows are put in buckets by the length of their vector, within groups of labels; a bucket is dealt to blocks of bounded
size by a hash. A block has its rows in order of length and, for each coordinate, the list of its values in order. An
anchor that needs a score of at least t looks at a block in this way: if even the longest vector can't reach t, at nothing;
else its focus coordinates, those of the largest values, have a range each in which a row that reaches t must lie (the
angles to the axis differ by arccos of the scaled t at most). The shortest range is cut with the others, and what is left is
scored exactly. If the ranges leave most of the block, all rows that are long enough are scored in one product.

Four visits, the first two for positives and the others for negatives: of each pair one gives a bound from one block, the
other goes to all blocks that can hold an answer, with that bound. Blocks hold anchors of a stretch at a time, and anchors are
dealt to several tasks a block when they are many; a block returns the best few rows of each question only.

Defined results: rows without vec_id or label, or whose vector is null or has null or non-finite components, take no part;
of rows with one vec_id that with the least (label, vector) does; shorter vectors count as having zeros at their end;
positives with a score below zero have no negatives (the range is empty). Scores must fit a long. Ties go to
the smaller vec_id. Further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, groups
from .vector_codes import finite, integers

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: Least and largest share, in percent of the positive's score, of a negative's score.
SHARE = (50, 95)
#: Groups of labels, ratio of a bucket's lengths, rows of a block, anchors of a task.
GROUPS, RATIO, BLOCK, ASKED = 16, 1.1, 2048, 100_000
FOCUS = 3
_ASK = "array<struct<slot:long,low:long,high:long>>"


class Block:
    """Rows in order of length, the longest first, with sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.labels, self.length = ids[order], labels[order], length[order]
        self.rows = rows[order]
        largest = int(np.abs(rows).max(initial=0))
        self.exact = largest
        self.unit = self.rows / np.maximum(self.length, 1e-300)[:, None]
        self.list_order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.list_order, axis=0)
        self.real = self.rows.astype(np.float64)

    def scores(self, asked: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        """Inner products as whole numbers; by doubles where those hold them exactly."""
        largest = self.exact * int(np.abs(asked).max(initial=0)) * max(1, self.rows.shape[1])
        return (asked.astype(np.float64) @ self.real[rows].T).astype(np.int64) if largest < 1 << 53 else asked @ self.rows[rows].T

    def candidates(self, asked: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(question, rows, their scores): all rows of the block that reach the score ``least`` (NaN: any), and some others."""
        n, d = self.rows.shape
        size = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))
        bar = np.where(np.isnan(least) | (least <= 0), -1.0, least / np.maximum(size * self.length[0], 1e-300))
        bar[(size * self.length[0] == 0) & (least > 0)] = 2.0
        open_ = np.flatnonzero(bar <= 1 + 1e-9)
        long_enough = np.full(len(asked), n)
        some = open_[bar[open_] > 0]
        if len(some):
            long_enough[some] = np.searchsorted(-self.length, -(least[some] / size[some]) * (1 - 1e-9), side="right")
            unit = asked[some] / size[some][:, None]
            focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
            angle = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
            reach = np.arccos(np.clip(bar[some], -1, 1))[:, None] + 1e-6
            low, high = np.cos(np.minimum(angle + reach, math.pi)) - 1e-9, np.cos(np.maximum(angle - reach, 0)) + 1e-9
            begin, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
            for f in np.unique(focus):
                at = focus == f
                begin[at], end[at] = np.searchsorted(self.lists[:, f], low[at]), np.searchsorted(self.lists[:, f], high[at], side="right")
            shortest = (end - begin).argmin(axis=1)
            pick = np.arange(len(some))
            narrow = end[pick, shortest] - begin[pick, shortest] < n // 2
            for i in np.flatnonzero(narrow).tolist():
                s = int(shortest[i])
                rows = self.list_order[begin[i, s] : end[i, s], focus[i, s]]
                rows = rows[rows < long_enough[some[i]]]
                for o in range(focus.shape[1]):
                    if o != s:
                        x = self.unit[rows, focus[i, o]]
                        rows = rows[(x >= low[i, o]) & (x <= high[i, o])]
                if len(rows):
                    yield int(some[i]), rows, self.scores(asked[some[i]][None], rows)[0]
            open_ = np.setdiff1d(open_, some[narrow])
        for at in range(0, len(open_), 256):
            part = open_[at : at + 256]
            most = int(long_enough[part].max(initial=0))
            for i, s in zip(part.tolist(), self.scores(asked[part], slice(0, most)), strict=True):
                yield i, np.arange(most), s


def answers(block: Block, asked: np.ndarray, ids: np.ndarray, labels: np.ndarray, slots: list[list[dict[str, Any]]], same: bool, k: int) -> Iterator[tuple[int, dict[str, Any], np.ndarray, np.ndarray]]:
    """(question, slot, vec_ids, scores): of rows with the anchor's label, or with others, the best k with a score from low to high."""
    least = np.array([min((math.nan if s["low"] is None else float(s["low"]) for s in own), default=math.inf, key=lambda x: -math.inf if math.isnan(x) else x) for own in slots])
    for i, rows, score in block.candidates(asked, least):
        ok = (block.labels[rows] == labels[i]) == same
        ok &= block.ids[rows] != ids[i]
        if not math.isnan(least[i]):
            ok &= score >= least[i] - 1
        tops = [s["high"] for s in slots[i]]
        if None not in tops:
            ok &= score <= max(tops)
        rows, score = rows[ok], score[ok]
        order = np.lexsort((block.ids[rows], -score))
        rows, score = rows[order], score[order]
        for s in slots[i]:
            a = 0 if s["high"] is None else int(np.searchsorted(-score, -s["high"], side="left"))
            b = len(score) if s["low"] is None else int(np.searchsorted(-score, -s["low"], side="right"))
            b = min(b, a + k)
            if a < b:
                yield i, s, block.ids[rows[a:b]], score[a:b]


def grid(column: pa.Array, width: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def visit(rows: DataFrame, asks: DataFrame, width: int, tasks: int, same: bool, k: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the answers of each block to its questions. ``asks``: block, vec_id, label, v, slots."""
    copies = rows.select("block", F.lit(0).alias("kind"), "vec_id", "label", "v", F.lit(None).cast(_ASK).alias("slots"))
    copies = copies.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))) if tasks > 1 else copies.withColumn("deal", F.lit(0))
    questions = asks.select("block", F.lit(1).alias("kind"), "vec_id", "label", "v", "slots", F.pmod(F.xxhash64("vec_id"), F.lit(tasks)).cast("int").alias("deal"))
    dealt = copies.unionByName(questions).select("block", "deal", "kind", "vec_id", "label", "v", "slots").repartition("block", "deal").sortWithinPartitions("block", "deal", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[int, int] | None = None
        held: list[pa.RecordBatch] = []
        block: Block | None = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (here := (int(keys[a, 0]), int(keys[a, 1]))) != place:
                    place, held, block = here, [], None
                if keys[a, 2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    block = Block(t.column(3).to_numpy(), t.column(4).to_numpy(), grid(t.column(5).combine_chunks(), width))
                out: tuple[list[Any], ...] = ([], [], [], [])
                ids = part.column(3).to_numpy()
                for i, s, found, score in answers(block, grid(part.column(5), width), ids, part.column(4).to_numpy(), part.column(6).to_pylist(), same, k):
                    for o, x in zip(out, ([int(ids[i])] * len(found), [s["slot"]] * len(found), found.tolist(), score.tolist()), strict=True):
                        o += x
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["anchor_id", "slot", "vec_id", "score"])

    return dealt.mapInArrow(work, "anchor_id long, slot long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each anchor and slot, with their rank."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocked(vectors: DataFrame, anchor: Column, k: int) -> tuple[DataFrame, list[dict[str, Any]], int, int]:
    """Rows (block, vec_id, label, v, cell group and bound) dealt to blocks; the buckets with their numbers of blocks; the width of a vector; the number of anchors.

    Of an anchor, ``bound`` is the k-th score of its label within its own block."""
    one = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bucket = F.when(square > 0, F.floor(F.log(square) / (2 * math.log(RATIO)))).otherwise(-1).cast("int")
    one = cut(one.select("vec_id", F.col("label").cast("long").alias("label"), "v", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int").alias("g"), bucket.alias("b"), square.alias("square"), anchor.alias("anchor")))
    sizes = one.groupBy("g", "b").agg(F.count("*").alias("n"), F.max("square").alias("square"), F.max(F.size("v")).alias("width"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.min("label").alias("first"), F.max("label").alias("last"))
    cells = [r.asDict() for r in sizes.collect()]  # buckets, not rows: GROUPS times the powers of RATIO in the range of lengths
    for i, c in enumerate(cells):
        c["cell"], c["blocks"] = i, -(-c["n"] // BLOCK)
    width = max([1, *(c["width"] for c in cells)])
    listed = one.sparkSession.createDataFrame([(c["g"], c["b"], c["cell"], c["blocks"]) for c in cells], "g int, b int, cell long, blocks long")
    own = one.join(F.broadcast(listed), ["g", "b"]).withColumn("block", F.shiftleft("cell", 32) + F.pmod(F.xxhash64("vec_id"), F.col("blocks")))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in groups(batches, 1):
            for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                part = rows.slice(b, e - b)
                ids, labels, v = part.column(1).to_numpy(), part.column(2).to_numpy(), grid(part.column(3), width)
                asks = np.flatnonzero(part.column(5).to_numpy(zero_copy_only=False))
                kth: list[int | None] = [None] * len(ids)
                if len(asks):
                    for i, _, found, score in answers(Block(ids, labels, v), v[asks], ids[asks], labels[asks], [[{"slot": 0, "low": None, "high": None}]] * len(asks), True, k):
                        if len(found) == k:
                            kth[asks[i]] = int(score[-1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kth, pa.int64())], [*part.schema.names, "bound"])

    dealt = own.select("block", "vec_id", "label", "v", "g", "anchor").repartition("block").sortWithinPartitions("block")
    out = dealt.mapInArrow(bound, "block long, vec_id long, label long, v array<long>, g int, anchor boolean, bound long")
    return cut(out), cells, width, sum(c["anchors"] for c in cells)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, label, v: whole numbers) where ``anchor`` holds."""
    rows, cells, width, n = blocked(vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()), anchor, positives)
    tasks = max(1, -(-n // ASKED))
    asked = rows.where("anchor").select("vec_id", "label", "v", "g", "bound")
    # A group all of whose rows have one label holds no negatives of it.
    alone = {g: lo if (lo := min(c["first"] for c in cells if c["g"] == g)) == max(c["last"] for c in cells if c["g"] == g) else None for g in {c["g"] for c in cells}}
    plain = [{"g": c["g"], "cell": c["cell"], "blocks": c["blocks"], "square": c["square"], "only": alone[c["g"]]} for c in cells]
    listed = F.from_json(F.lit(json.dumps(plain)), "array<struct<g:int,cell:long,blocks:long,square:double,only:long>>")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    foreign = lambda c: ~F.coalesce(c["only"] == F.col("label"), F.lit(False))

    def routed(asks: DataFrame, wanted: Any, least: Column) -> DataFrame:  # noqa: ANN401
        """A row for each block of the buckets wanted, but for those too short to reach ``least``."""
        reach = lambda c: F.coalesce((least <= 0) | (size * F.sqrt(c["square"]) * (1 + 1e-9) >= least), F.lit(True))
        to = asks.withColumn("c", F.explode(F.filter(listed, lambda c: wanted(c) & reach(c))))
        return to.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c.blocks") - 1), lambda i: F.shiftleft("c.cell", 32) + i)))

    slot = F.array(F.struct(F.col("vec_id").alias("slot"), F.col("bound").alias("low"), F.lit(None).cast("long").alias("high")))
    near = best(visit(rows, routed(asked, lambda c: c["g"] == F.col("g"), F.col("bound")).withColumn("slots", slot), width, tasks, True, positives), positives)
    near = cut(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.expr(f"({share[0]} * score + 99) div 100")).alias("low"), (F.expr(f"({share[1]} * score) div 100")).alias("high")).where("positive_score >= 0"))

    def questions(slots: DataFrame) -> DataFrame:
        own = slots.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("slot"), "low", "high")).alias("slots"))
        return asked.join(own, "vec_id")

    others = F.filter(listed, foreign)
    some = F.expr("element_at(others, cast(1 + pmod(xxhash64(vec_id, 1), size(others)) as int))")
    first = questions(near.where("low <= high")).withColumn("others", others).where(F.size("others") > 0).withColumn("c", some)
    first = first.withColumn("block", F.shiftleft("c.cell", 32) + F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("c.blocks")))
    seeds = best(visit(rows, first, width, tasks, False, negatives), negatives).where(F.col("rank") == negatives).select("anchor_id", F.col("slot").alias("positive_id"), F.col("score").alias("seed"))
    bounded = near.where("low <= high").join(seeds, ["anchor_id", "positive_id"], "left").withColumn("low", F.greatest("low", F.coalesce("seed", "low")))
    least = F.array_min(F.transform("slots", lambda s: s["low"]))
    far = best(visit(rows, routed(questions(bounded), foreign, least), width, tasks, False, negatives), negatives)
    scored = near.select("anchor_id", F.col("positive_id").alias("slot"), "positive_score")
    return far.join(scored, ["anchor_id", "slot"]).select("anchor_id", F.col("slot").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(embeddings: DataFrame) -> DataFrame:
    """Negatives of every fiftieth row, where every seventh row has the next label, of components in steps of 1 / SCALE."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = embeddings.where(finite(F.col("embedding")) & F.col("label").isNotNull()).select("vec_id", moved.alias("label"), integers(F.col("embedding"), SCALE).alias("v"))
    return mine(v, F.col("vec_id") % 50 == 0)
