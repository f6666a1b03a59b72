"""Benchmark decontamination: a generalised suffix automaton of the items, along which the words of the documents stream.

The automaton recognises every run of consecutive words of any item. Along a document it keeps the length of
the longest run that ends at each word; where that reaches a window (13 words, or all words of a shorter item)
the window's words are hit, and the state names the items that hold it. A word that no item has resets the
automaton, so only runs of item words of at least the shortest window are streamed.

Items are read as pieces that overlap by a window less one word, and pieces are dealt to blocks of about
``BLOCK_WORDS``. The hits of each further block are written before the next automaton is built, so two at most are held at a
time, that of the first block and one more; more items mean more passes, not a larger broadcast. Words are told apart by 64-bit hashes.

Defined results: null and empty texts have no words and are never hit; an item without words or without an
item_id has no window; item ids that occur twice count once; repeated rows each get their result.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, only_listed, span_hashes, text_chunks, word_spans

WINDOW = 13
#: Words of items in one automaton: it takes some hundreds of bytes a word.
BLOCK_WORDS = 200_000
#: A document is contaminated if at least one in so many of its words is hit.
COVERAGE = 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Digits, lower-case ASCII letters and all that is not ASCII.
ITEM_WORD_BYTES = np.zeros(256, dtype=bool)
ITEM_WORD_BYTES[0x30:0x3A] = ITEM_WORD_BYTES[0x61:0x7B] = ITEM_WORD_BYTES[0x80:] = True


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, starts, ends, rows, hashes of the words) by chunk."""
    for first, raw, at in text_chunks(column):
        low = LOWER[raw]
        starts, ends, row = word_spans(low, at, ITEM_WORD_BYTES)
        yield first, raw, at, starts, ends, row, span_hashes(low, starts, ends)


class SuffixAutomaton:
    """Of sequences of word numbers (from 1). ``windows[s]`` are the items of the window that state s ends; ``whole[s]`` the short items that end at s, as (words, item)."""

    def __init__(self, pieces: list[tuple[int, bool, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, _, words in pieces:
            last = 0
            for w in words:
                last = self._extend(last, w)
        own: list[set[int]] = [set() for _ in self.next]
        short: dict[int, list[tuple[int, int]]] = {}
        for item, whole, words in pieces:
            s = 0
            for w in words:
                s = self.next[s][w]
                v = s
                while self.length[v] >= window and item not in own[v]:
                    own[v].add(item)
                    v = self.link[v]
            if whole and len(words) < window:
                short.setdefault(s, []).append((len(words), item))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.windows: list[tuple[int, ...]] = [()] * len(self.next)
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.windows[s] = tuple(own[s]) if self.length[up] < window else self.windows[up]
            if up >= 0:
                self.whole[s] = tuple(short.get(s, ())) + self.whole[up]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the runs of q that p + w has."""
        new = self._state(self.length[p] + 1)
        self.next[new], self.link[new] = dict(self.next[q]), self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first word, end, item) of the windows in a sequence."""
        nxt, link, length, windows, whole, window = self.next, self.link, self.length, self.windows, self.whole, self.window
        s = longest = 0
        for i, w in enumerate(words):
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                longest = length[s]
                t = nxt[s].get(w)
            if t is None:
                continue
            s, longest = t, longest + 1
            if longest >= window:
                for item in windows[s]:
                    yield i + 1 - window, i + 1, item
            for n, item in whole[s]:
                if n <= longest:
                    yield i + 1 - n, i + 1, item


def item_pieces(items: DataFrame, window: int, piece: int) -> DataFrame:
    """(item_id, whole, words array<long> of hashes); pieces overlap by window - 1 words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, _, at, _, _, row, hashes in _words(batch.column(1)):
                got: list[tuple[int, bool, np.ndarray]] = []
                begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at) - 1))]).astype(np.int64)
                for r in range(len(at) - 1):
                    own = hashes[begin[r] : begin[r + 1]].view(np.int64)
                    n = len(own)
                    got += [(ids[first + r], n <= piece, own[i : i + piece]) for i in range(0, max(n - window + 1, 1), piece - window + 1) if n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.list_(pa.int64()))], names=["item_id", "whole", "words"]
                )

    return items.select(F.col("item_id").cast("long"), "text").where("item_id is not null").mapInArrow(read, "item_id long, whole boolean, words array<long>").distinct()


def _matcher(blob: object, named: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds n_words, hit spans (merged, as starts and ends) and item ids to batches whose column ``named`` is the text."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, automaton, shortest = pickle.loads(blob.value)  # type: ignore[attr-defined]
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(named))
            n_words, starts, ends, items = np.zeros(len(text), np.int64), [], [], []
            for first, _, at, _, _, row, hashes in _words(text):
                n = len(at) - 1
                count = np.bincount(row, minlength=n)
                begin = np.concatenate([[0], np.cumsum(count)])
                n_words[first : first + n] = count
                spans: dict[int, tuple[list[int], list[int], set[int]]] = {}
                if len(vocabulary) and len(hashes):
                    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    number = np.where(vocabulary[place] == hashes, place + 1, 0)
                    brk = np.flatnonzero((number[1:] == 0) != (number[:-1] == 0)) + 1
                    cuts = np.unique(np.concatenate([[0], brk, begin[:-1][count > 0], [len(number)]]))
                    long = np.flatnonzero((np.diff(cuts) >= shortest) & (number[cuts[:-1]] > 0))
                    for a, b in zip(cuts[long].tolist(), cuts[long + 1].tolist()):
                        r = int(row[a])
                        for s, e, item in automaton.stream(number[a:b].tolist()):
                            s, e = s + a - int(begin[r]), e + a - int(begin[r])
                            if r not in spans:
                                spans[r] = ([s], [e], {item})
                                continue
                            ss, ee, own = spans[r]
                            own.add(item)
                            while ss and s <= ss[-1] and e >= ee[-1]:  # windows end in order, but a later one can be longer
                                ss.pop(), ee.pop()
                            if ss and s <= ee[-1]:
                                ee[-1] = max(ee[-1], e)
                            else:
                                ss.append(s), ee.append(e)
                for r in range(n):
                    x = spans.get(r, ((), (), ()))
                    starts.append(list(x[0])), ends.append(list(x[1])), items.append(sorted(x[2]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends, items))], names=[*batch.schema.names, "n_words", "hit_starts", "hit_ends", "items"]
            )

    return match


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Broadcast[bytes]]:
    """Broadcasts, a block each, of (sorted word hashes, automaton, shortest window), one a block."""
    spark = items.sparkSession
    pieces = cut(item_pieces(items, window, max(block_words // 4, 2 * window)))
    words = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, math.ceil(words / block_words))
    for k in range(n):
        own = [(r["item_id"], r["whole"], r["words"]) for r in pieces.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k).orderBy("item_id").collect()]
        vocabulary = np.unique(np.array([w for _, _, ws in own for w in ws], dtype=np.int64).view(np.uint64))
        number = {int(w): i + 1 for i, w in enumerate(vocabulary.view(np.int64).tolist())}
        automaton = SuffixAutomaton([(i, whole, [number[w] for w in ws]) for i, whole, ws in own], window)
        shortest = min([window, *(len(ws) for _, whole, ws in own if whole)])
        yield spark.sparkContext.broadcast(pickle.dumps((vocabulary, automaton, shortest)))


ADDED = "n_words long, hit_starts array<long>, hit_ends array<long>, items array<long>"


def matches(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row struct of ``docs``, n_words, hit_starts, hit_ends, items): hit spans in words, disjoint and in order if there is one block.

    With several blocks the rows are numbered in a written table, and each block is a pass over it, whose hits are written; only the numbers, spans and items
    of rows that a further block hits are shuffled, and of the rows themselves only those."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    blocks = _blocks(items, window, block_words)
    first_block, block = next(blocks), next(blocks, None)
    several = block is not None
    if several:
        packed = cut(packed.withColumn("number", F.monotonically_increasing_id()))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in packed.schema)}, {ADDED}"
    first = packed.mapInArrow(_matcher(first_block, "text"), schema).drop("text")
    if not several:
        return first
    more = []
    while block is not None:
        found = packed.mapInArrow(_matcher(block, "text"), schema).where(F.size("items") > 0)
        more.append(cut(found.select("number", F.arrays_zip("hit_starts", "hit_ends").alias("spans"), "items")))
        block.destroy()
        block = next(blocks, None)
    hits = cut(functools.reduce(DataFrame.union, more).groupBy("number").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("more")))
    discard(*more)
    flagged = only_listed(first, "number", hits, flag=True)
    spans = F.array_sort(F.concat(F.arrays_zip("hit_starts", "hit_ends"), F.coalesce("spans", F.array().cast("array<struct<hit_starts:bigint,hit_ends:bigint>>"))))
    met = flagged.where("listed").join(hits, "number", "left").select("row", "n_words", spans.alias("spans"), F.array_distinct(F.concat("items", F.coalesce("more", F.array().cast("array<bigint>")))).alias("items"))
    met = met.select("row", "n_words", F.transform("spans", lambda x: x["hit_starts"]).alias("hit_starts"), F.transform("spans", lambda x: x["hit_ends"]).alias("hit_ends"), "items")
    return flagged.where("not listed").select("row", "n_words", "hit_starts", "hit_ends", "items").union(met)


def hit_words() -> Column:
    """Words in the union of the spans."""
    return F.aggregate(
        F.arrays_zip("hit_starts", "hit_ends"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["hit_ends"] - F.greatest(x["hit_starts"], a["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["end"], x["hit_ends"]).alias("end")),
        lambda a: a["n"],
    )


def contaminated(coverage: int = COVERAGE) -> Column:
    return (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs`` (doc_id, text)."""
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return (
        matches(docs.select("doc_id", "text"), items, **options)
        .select(F.col("row.doc_id").alias("doc_id"), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
        .withColumn("contaminated", contaminated())
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with its columns."""
    return matches(docs, items, **options).withColumn("n_hit", hit_words()).where(~contaminated()).select("row.*")


def cut_spans(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """``drop_contaminated``, with the hit words of the remaining texts taken out as well."""
    left = matches(docs, items, **options).withColumn("n_hit", hit_words()).where(~contaminated())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, from_, to = batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[str | None] = text.to_pylist()
            for first, raw, at, starts, ends, row, _ in _words(text):
                begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at) - 1))]).astype(np.int64)
                for r in range(len(at) - 1):
                    if from_[first + r]:
                        whole, p, parts = raw[at[r] : at[r + 1]].tobytes(), 0, []
                        for a, b in zip(from_[first + r], to[first + r]):
                            parts.append(whole[p : max(p, starts[begin[r] + a] - at[r])])
                            p = max(p, int(ends[begin[r] + b - 1] - at[r]))
                        out[first + r] = b"".join([*parts, whole[p:]]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "cleaned"])

    kind = left.schema["row"].dataType.simpleString()
    done = left.select("row", F.col("row.text").alias("text"), "hit_starts", "hit_ends").mapInArrow(clean, f"row {kind}, cleaned string")
    return done.select(*[F.col("cleaned").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
