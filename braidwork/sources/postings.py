"""A stored inverted index in plain Parquet: postings in blocks, partitioned by a hash of the term, and a vocabulary.

A write is a segment, a folder of that name in each of the tables:

* ``docs``: a row a document with its columns (all but the text), its number of words, the version of the write, and
  whether the document is gone;
* ``postings``: a row a term and slice of documents, with the documents and the term's positions in them as arrays, and the
  largest frequency and the least length of the row, which bound every score in it. A slice is a run of at most ``SLICE``
  documents that one task reads, and of ``WORDS`` words unless one text has more, so a row is bounded whatever the term;
* ``terms``: the vocabulary, each file in order, so that a prefix reads few pages of it;
* ``variants``: each term under its three parts, each with its place and the term's length. Two edits leave a part as it is, so
  of two terms within two edits one holds a part of the other near its place: near terms are looked up, not searched for.

The task that reads documents also makes and sorts their blocks, so nothing is shuffled, and a term is in ``terms`` and
``variants`` once for each task that had it.

Of a document the last version counts, so a repeated, changed or deleted one needs no change of older segments:
their postings don't meet its live row. ``merge`` writes the live documents of several segments as one: blocks of well
filled slices lose their dead documents where they are, others are dealt into new slices. A segment is
written under a new name; a name that is used again replaces the folder.
"""

from __future__ import annotations

import itertools
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.text import tokens

SLICE, BUCKETS, PREFIX = 1024, 16, 7
#: Words of a slice, unless one text has more.
WORDS = 1 << 20
#: Terms that a query lists in its filter at most.
LISTED = 1000
#: Values in one filter that reach the files' statistics one by one (Spark's spark.sql.parquet.pushdown.inFilterThreshold).
PUSHED = 10
#: A merge keeps the slices of a segment if they are filled so far on average.
FILLED = 0.25
#: Bits of the bitmaps of live and of dead documents that a merge broadcasts, 16 a document within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 28


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_of(term: str) -> int:
    """The same on the driver."""
    return xxhash.xxh64_intdigest(term.encode(), seed=42) % BUCKETS  # BUCKETS divides 2^64, so the sign doesn't matter


#: Parts of a term. Two edits leave one of them as it is.
PARTS = 3


def variants(term: Column) -> Column:
    """The parts of a term: its length, the part's number and the part's first ``PREFIX`` characters."""
    n = F.length(term)
    at = [F.floor(n * i / PARTS).cast("int") for i in range(PARTS + 1)]
    return F.array(*[F.concat_ws(".", n.cast("string"), F.lit(str(i)), F.substring(term, at[i] + 1, F.least(at[i + 1] - at[i], F.lit(PREFIX)))) for i in range(PARTS)])


def variants_of(word: str, edits: int) -> list[str]:
    """The variants, one of which any term within the edits (two at most) has: parts of terms of its length as they lie in the word, by as many characters beside their place."""
    if edits >= PARTS:
        raise ValueError(f"edits are up to {PARTS - 1}")
    out = set()
    for n in range(max(len(word) - edits, 0), len(word) + edits + 1):
        for i in range(PARTS):
            first, end = i * n // PARTS, (i + 1) * n // PARTS
            for x in range(max(first - edits, 0), first + edits + 1):
                if x + end - first <= len(word):
                    out.add(f"{n}.{i}.{word[x : x + min(end - first, PREFIX)]}")
    return sorted(out)


#: Words whose positions are gathered at once, unless a text has more.
AT_ONCE = 1 << 18


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, words) to (doc, dl, term, positions): a document's terms are gathered in its task."""
    for batch in batches:
        size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, end = batch.column(1).flatten(), np.cumsum(size)
        first = 0
        while first < batch.num_rows:
            start = end[first] - size[first]
            last = max(int(np.searchsorted(end, start + AT_ONCE, "right")), first + 1)
            own = size[first:last]
            words = flat.slice(start, end[last - 1] - start).dictionary_encode()
            row, word = np.repeat(np.arange(last - first), own), words.indices.to_numpy().astype(np.int64)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
            order = np.lexsort((word, row))  # stable: positions stay in order
            row, word, pos = row[order], word[order], pos[order].astype(np.int32)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
            at = np.flatnonzero(new)
            positions = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(row)]]).astype(np.int32)), pa.array(pos))
            docs = batch.column(0).slice(first, last - first).take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays([docs, pa.array(own[row[at]].astype(np.int32)), words.dictionary.take(pa.array(word[at])), positions], names=["doc", "dl", "term", "positions"])
            first = last


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """(doc, words) in runs of ``SLICE`` rows and ``WORDS`` words at most, but a row at least."""
    kept: list[pa.RecordBatch] = []
    rows = words = 0
    for batch in batches:
        size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        first = 0
        while first < batch.num_rows:
            start = int(end[first] - size[first])
            last = min(int(np.searchsorted(end, start + WORDS - words, "right")), first + SLICE - rows, batch.num_rows)
            if not rows:
                last = max(last, first + 1)
            if last > first:
                kept.append(batch.slice(first, last - first))
                rows, words, first = rows + last - first, words + int(end[last - 1]) - start, last
            if first < batch.num_rows:
                yield kept
                kept, rows, words = [], 0, 0
    if kept:
        yield kept


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, words) to the blocks of the slices that they make up."""
    numbers = itertools.count(TaskContext.get().partitionId() << 32)
    for own in _slices(batches):
        rows = pa.Table.from_batches(list(_by_term(iter(own))))
        if not rows.num_rows:
            continue
        terms = rows.column("term").combine_chunks().dictionary_encode()
        word = terms.indices.to_numpy()
        order = np.argsort(word, kind="stable")
        docs, dl, positions = (rows.column(c).combine_chunks().take(pa.array(order)) for c in ("doc", "dl", "positions"))
        word = word[order]
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        offsets = pa.array(np.append(at, len(word)).astype(np.int32))
        most, least = np.maximum.reduceat(pc.list_value_length(positions).to_numpy(), at), np.minimum.reduceat(dl.to_numpy(), at)
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (docs, positions)]
        yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(word[at])), pa.array(np.full(len(at), next(numbers))), *lists, pa.array(most.astype(np.int32)), pa.array(least)], names=_BLOCK)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted terms without those that are equal to the one before."""
    last = None
    for batch in batches:
        if batch.num_rows:
            terms = batch.column(0)
            before = pa.concat_arrays([pa.array([last], terms.type), terms.slice(0, len(terms) - 1)])
            yield batch.filter(pc.fill_null(pc.not_equal(terms, before), True))
            last = terms[-1].as_py()


def _bitmap(rows: DataFrame, slot: Column, bits: int) -> Broadcast[bytes]:
    """A broadcast bitmap, with those bits set that ``slot`` (0 to bits - 1) has in the rows."""
    parts = rows.select((slot + 1).alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out.tobytes())


def _entries_of(live: Broadcast[bytes], dead: Broadcast[bytes], sure: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks, with the slots of their documents, to the blocks of those that are live for sure (their slot is none of a dead document), or of those that may be either."""

    def bit(shared: Broadcast[bytes], slots: np.ndarray) -> np.ndarray:
        return (np.frombuffer(shared.value, dtype=np.uint8)[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("slots").flatten().to_numpy().astype(np.int64)
            pick = np.flatnonzero(bit(live, slots) & (bit(dead, slots) != sure))
            if not len(pick):
                continue
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("slots")).to_numpy())[pick]
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            offsets = pa.array(np.append(at, len(row)).astype(np.int32))
            docs, positions = (batch.column(c).flatten().take(pa.array(pick)) for c in ("docs", "positions"))
            most = np.maximum.reduceat(pc.list_value_length(positions).to_numpy(), at)
            own = batch.select(["segment", "term", "slice", "min_dl"]).take(pa.array(row[at]))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (docs, positions)]
            yield pa.RecordBatch.from_arrays([own.column("segment"), own.column("term"), own.column("slice"), *lists, pa.array(most), own.column("min_dl")], names=["segment", *_BLOCK])

    return run


_BLOCK = ["term", "slice", "docs", "positions", "max_tf", "min_dl"]
_BLOCKS = "term string, slice long, docs array<{key}>, positions array<array<int>>, max_tf int, min_dl int"
_SCHEMAS = {"postings": f"{_BLOCKS}, segment string, bucket int", "terms": "term string, segment string", "variants": "term string, variant string, segment string"}


@dataclass(frozen=True)
class Index:
    """Keys are unique within a write, and not null."""

    spark: SparkSession
    path: str
    key: str = "message_id"
    _frames: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def _at(self, table: str) -> str:
        return posixpath.join(self.path, table)

    def read(self, table: str) -> DataFrame:
        """A table with all segments; docs of deletes have the key only. Its files are listed once, until this object writes."""
        if table not in self._frames:
            self._frames[table] = self._read(table)
        return self._frames[table]

    def refresh(self) -> None:
        """See what others have written."""
        self._frames.clear()

    def _read(self, table: str) -> DataFrame:
        if table == "docs":
            return self.spark.read.option("mergeSchema", "true").parquet(self._at("docs"))
        schema = _SCHEMAS[table].format(key=self.read("docs").schema[self.key].dataType.simpleString())
        return self.spark.read.schema(schema).parquet(self._at(table)) if self.segments(table) else self.spark.createDataFrame([], schema)

    def segments(self, table: str = "docs") -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(table))  # type: ignore[union-attr]
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[union-attr]
        return sorted(s.getPath().getName()[8:] for s in files.listStatus(path) if s.getPath().getName().startswith("segment=")) if files.exists(path) else []

    def write(self, docs: DataFrame, segment: str, version: int, text: str = "text") -> None:
        """Add or replace documents: rows with the key, the text and further columns. The rows of ``docs`` appear last, when the postings are whole."""
        parallel = self.spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < parallel:  # files of one row group are one task
            docs = docs.repartition(parallel)
        words = docs.select(F.col(self.key).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        self._put_postings(words.mapInArrow(_blocks, _BLOCKS.format(key=docs.schema[self.key].dataType.simpleString())), segment)
        lengths = docs.withColumn("dl", F.size(tokens(F.coalesce(F.col(text), F.lit(""))))).drop(text)
        self._put_docs(lengths.withColumn("_gone", F.lit(False)), segment, version)

    def _put_postings(self, blocks: DataFrame, segment: str) -> None:
        """Blocks, vocabulary and variants of a segment, each sorted by the tasks that make them."""
        if not segment[:1].isalpha() or not segment.replace("-", "").isalnum():
            raise ValueError("a segment is named by a letter, then letters, digits and -")
        where = lambda table: posixpath.join(self._at(table), f"segment={segment}")
        put = lambda rows: rows.write.mode("overwrite").option("compression", "zstd")
        put(blocks.withColumn("bucket", bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "slice")).partitionBy("bucket").parquet(where("postings"))
        written = self.spark.read.schema("term string").parquet(where("postings")).select("term")
        put(written.sortWithinPartitions("term").mapInArrow(_once, "term string")).parquet(where("terms"))
        vocabulary = self.spark.read.schema("term string").parquet(where("terms"))
        put(vocabulary.select("term", F.explode(variants(F.col("term"))).alias("variant")).sortWithinPartitions("variant", "term")).parquet(where("variants"))

    def delete(self, keys: DataFrame, segment: str, version: int) -> None:
        self._put_docs(keys.select(self.key).distinct().withColumn("_gone", F.lit(True)), segment, version)

    def _put_docs(self, rows: DataFrame, segment: str, version: int) -> None:
        """Last of a write: a segment without its row here has no live document."""
        rows.withColumn("_version", F.lit(version).cast("long")).write.mode("overwrite").parquet(posixpath.join(self._at("docs"), f"segment={segment}"))
        self.refresh()

    def live(self, *columns: str) -> DataFrame:
        """The documents as last written, with their columns (or those named), ``dl`` and ``segment``."""
        rows = self.read("docs")
        if columns:
            rows = rows.select(*{self.key: 0, **dict.fromkeys(columns), "dl": 0, "segment": 0, "_gone": 0, "_version": 0})
        if len({f.rpartition("/segment=")[2].partition("/")[0] for f in rows.inputFiles()}) > 1:
            rest = [c for c in rows.columns if c != self.key]
            last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct("_version", "_gone", "segment")).alias("_r"))
            rows = last.select(self.key, "_r.*")
        return rows.where(~F.col("_gone")).drop("_gone", "_version")

    def merge(self, into: Index, segment: str, version: int) -> None:
        """The live documents of all segments as one segment of another index; texts aren't needed.

        Segments whose slices are well filled keep them: their dead documents are taken out of the blocks where these are, without a shuffle. Two bitmaps of
        fixed size tell most of them; documents that both bitmaps name, and those of other segments, are joined exactly and dealt into new slices."""
        live = self.live(self.key).select(F.col(self.key).alias("doc"), "dl", "segment")
        written = self.read("docs").where(~F.col("_gone")).select(F.col(self.key).alias("doc"), "segment")
        rows = self.read("postings")
        counts = live.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).join(written.groupBy("segment").agg(F.count("*").alias("all")), "segment")
        held = counts.join(rows.select("segment", "slice").distinct().groupBy("segment").agg(F.count("*").alias("slices")), "segment").collect()
        filled = [r for r in held if max(r["n"] / SLICE, r["words"] / WORDS) >= FILLED * r["slices"]]
        whole, mixed = ([r["segment"] for r in filled if (r["n"] == r["all"]) == x] for x in (True, False))
        small = [r["segment"] for r in held if r not in filled]
        of = F.col("segment").isin
        kept = rows.where(of(whole)).select("segment", *_BLOCK)
        loose, n = rows.where(of(small)).select("segment", *_BLOCK), sum(r["n"] for r in held if r["segment"] in small)
        if mixed:
            size = sum(r["all"] for r in filled if r["segment"] in mixed)
            bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * size).bit_length()))
            slot = lambda doc: F.pmod(F.xxhash64(doc, "segment"), F.lit(bits)).cast("int")
            gone = written.where(of(mixed)).join(live, ["doc", "segment"], "left_anti")
            maps = [_bitmap(x.where(of(mixed)), slot("doc").cast("long"), bits) for x in (live, gone)]
            told = rows.where(of(mixed)).select("segment", *_BLOCK, F.transform("docs", slot).alias("slots"))
            schema = "segment string, " + _BLOCKS.format(key=live.schema["doc"].dataType.simpleString())
            kept = kept.union(told.mapInArrow(_entries_of(*maps, sure=True), schema))
            loose = loose.union(told.mapInArrow(_entries_of(*maps, sure=False), schema))
            n += round(size * min(1, size / bits))
        kept = kept.withColumn("slice", F.xxhash64("segment", "slice")).select(*_BLOCK)
        into._put_postings(kept.union(_dealt(loose, live, max(1, -(-n // SLICE)))) if small or mixed else kept, segment)
        into._put_docs(self.live().drop("segment").withColumn("_gone", F.lit(False)), segment, version)

    def expansions(self, words: list[str], prefix: str | None, edits: dict[str, int]) -> DataFrame:
        """(term), some several times: the words, the terms that begin with ``prefix``, and those within the edits of a word, from the vocabulary and the variants of the words."""
        out = self.spark.createDataFrame([(w,) for w in words], "term string")
        if prefix:
            out = out.union(self.read("terms").where(F.col("term").startswith(prefix)).select("term"))
        for word, k in edits.items():
            if k:
                own = variants_of(word, k)
                among = reduce(or_, [F.col("variant").isin(own[i : i + PUSHED]) for i in range(0, len(own), PUSHED)])  # for the files; rows are told by one lookup before
                rows = self.read("variants").where(F.col("variant").isin(own)).where(among)
                out = out.union(rows.where(F.levenshtein(F.col("term"), F.lit(word), k).between(0, k)).select("term"))
        return out

    def postings_of(self, terms: DataFrame, matching: Column) -> DataFrame:
        """The postings of some terms: of their buckets only and, while they are at most ``LISTED``, with a filter that reaches the files' statistics. Beyond that they are those with ``matching``, true of just those terms: no posting is shuffled."""
        some = terms.distinct().limit(LISTED + 1).agg(F.collect_list("term")).first()[0]  # type: ignore[index]
        rows = self.read("postings")
        if len(some) <= LISTED:
            return rows.where(F.col("bucket").isin(sorted({bucket_of(x) for x in some})) & F.col("term").isin(sorted(some)))
        return rows.where(matching)


def _dealt(blocks: DataFrame, live: DataFrame, slices: int) -> DataFrame:
    """Blocks anew, of the live documents among those of ``blocks``, in so many slices. A document's entries are dealt as they are gathered."""
    each = blocks.select("segment", "term", F.explode(F.arrays_zip("docs", "positions")).alias("e")).select("segment", "term", F.col("e.docs").alias("doc"), F.col("e.positions").alias("positions"))
    own = each.join(live, ["doc", "segment"]).withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(slices))).withColumns({"bucket": bucket(F.col("term")), "part": F.pmod("slice", F.lit(16))})
    rows = own.repartition("bucket", "part").groupBy("bucket", "part", "term", "slice").agg(F.sort_array(F.collect_list(F.struct("doc", "positions"))).alias("e"), F.max(F.size("positions")).alias("max_tf"), F.min("dl").alias("min_dl"))
    return rows.select("term", "slice", F.col("e.doc").alias("docs"), "e.positions", "max_tf", "min_dl")
