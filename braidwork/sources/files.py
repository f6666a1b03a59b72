"""Folders of files: their description, whether they are readable text, and the text of bytes in a charset that nobody stated.

``source_files`` reads a folder; where the content isn't selected, no file is opened. ``readable`` tells text from binary formats by
extension and first bytes, in expressions. ``fit`` learns how often each pair of neighbouring bytes occurs in texts of each
charset; ``decoded`` takes the charset under which the bytes are likeliest. Files are read whole.

Defined results: null content has a null charset and text; empty content is an empty text in UTF-8; bytes that are valid UTF-8 and
hold no zero are UTF-8; a byte order mark decides; charsets that can't decode the bytes are passed over; ties go to the charset
named first; bytes that none can decode are Latin-1. Null keys and repeated rows are rows like others.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Extensions of files that are not read as text.
NOT_READABLE = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".ico", ".svg",
    ".mp3", ".wav", ".ogg", ".m4a", ".aac", ".flac",
    ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".xz",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".iso", ".dmg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)
#: Bytes that mark binary formats, anywhere in the first 32.
MAGIC = (
    b"\x00\x00\x00 ftyp", b"\x00\x00\x00\x14ftyp", b"\x00\x00\x00\x18ftyp", b"\x00\x00\x00\x1cftyp",
    b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"%PDF-", b"PK\x03\x04", b"\x7fELF", b"MZ",
)
HEAD = 32
#: A shorter text is none.
LEAST_TEXT = 6

CHARSETS = ("cp1252", "cp850", "mac_roman", "utf-16-le", "utf-16-be")
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Pairs of bytes, those at even places apart from those at odd ones: that alone tells which byte of a character comes first.
PAIRS = 1 << 17
#: Added to each count of a pair.
SMOOTH = 0.5
#: Bytes that are scored, or held decoded, at once.
PIECE = 4 << 20


def extension(name: Column) -> Column:
    """The last suffix of a file's name with its dot, lower-cased; empty for none. A leading dot begins no suffix."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, name, extension, size, modified, sha256, content) of the files under ``path``; like any source of Spark, it passes over empty ones and names that begin with a dot or an underscore."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return found.select(
        F.col("path").alias("file_id"), name.alias("name"), extension(name).alias("extension"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content",
    )


def is_binary(content: Column) -> Column:
    """Whether one of ``MAGIC`` lies in the first bytes."""
    head = F.hex(F.substring(content, 1, HEAD))
    # Two digits are a byte, so a mark counts from an even place only.
    return reduce(or_, [head.rlike(f"^(?:..)*?{m.hex().upper()}") for m in MAGIC])


def readable(content: Column, suffix: Column) -> Column:
    """The text of a readable file, else null: bytes that aren't UTF-8 and characters that can't be printed are left out, and blanks at the ends."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    clean = F.trim(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ \n\r\t]]+", ""), F.lit(" \n\r\t"))
    kept = ~F.coalesce(F.lower(suffix), F.lit("")).isin(*NOT_READABLE) & ~is_binary(content)
    return F.when(kept & (F.length(clean) >= LEAST_TEXT), clean)


def _seen(data: np.ndarray) -> np.ndarray:
    """How often each pair occurs in bytes that begin at an even place."""
    wide = data.astype(np.int64)
    return np.bincount(((np.arange(len(wide) - 1) & 1) << 16) | (wide[:-1] << 8) | wide[1:], minlength=PAIRS) if len(wide) > 1 else np.zeros(PAIRS, np.int64)


@dataclass(frozen=True)
class Charsets:
    """Logarithms of the shares of byte pairs, a row of ``PAIRS`` a charset: of one size whatever was learned from."""

    names: tuple[str, ...]
    shares: np.ndarray

    def best(self, content: bytes) -> list[str]:
        """The charsets from the likeliest on."""
        data = np.frombuffer(content, np.uint8)
        total = np.zeros(len(self.names))
        for at in range(0, len(data) - 1, PIECE):
            total += self.shares @ _seen(data[at : at + PIECE + 1])
        return [self.names[i] for i in np.argsort(-total, kind="stable")]

    def decode(self, content: bytes) -> tuple[str, str]:
        for mark, name in MARKS:
            if content.startswith(mark):
                try:
                    return name, content.decode(name)
                except UnicodeDecodeError:
                    break
        if 0 not in content:
            try:
                return "utf-8", content.decode("utf-8")
            except UnicodeDecodeError:
                pass
        for name in self.best(content):
            try:
                return name, content.decode(name)
            except UnicodeDecodeError:
                continue
        return "latin-1", content.decode("latin-1")


def fit(docs: DataFrame, charsets: Sequence[str] = CHARSETS, text: str = "text") -> Charsets:
    """Learned from all texts of ``docs``; characters that a charset lacks are left out there. Each task hands on its sums."""
    names = tuple(charsets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(names), PAIRS), np.int64)
        for batch in batches:
            for value in batch.column(0):
                whole = value.as_py() or ""
                for at in range(0, len(whole), PIECE):
                    for i, name in enumerate(names):
                        seen[i] += _seen(np.frombuffer(whole[at : at + PIECE].encode(name, "ignore"), np.uint8))
        which, pair = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(pair), pa.array(seen[which, pair])], names=["charset", "pair", "n"])

    sums = docs.select(text).mapInArrow(count, "charset long, pair long, n long").groupBy("charset", "pair").agg(F.sum("n").alias("n"))
    counts = np.full((len(names), PAIRS), SMOOTH)
    # At most PAIRS rows a charset.
    got = sums.toArrow()
    counts[got["charset"].to_numpy(), got["pair"].to_numpy()] += got["n"].to_numpy()
    return Charsets(names, np.log(counts / counts.sum(axis=1, keepdims=True)))


def decoded(files: DataFrame, model: Charsets, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, charset, text) for each row of ``files``."""
    shared = files.sparkSession.sparkContext.broadcast(model)
    named = T.StructType([files.schema[key], T.StructField("charset", T.StringType()), T.StructField("text", T.StringType())])
    schema = to_arrow_schema(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, texts, start, size = batch.column(0), [], [], 0, 0
            for i, value in enumerate(batch.column(1)):
                data = value.as_py()
                name, text = (None, None) if data is None else shared.value.decode(data)
                names.append(name)
                texts.append(text)
                size += len(data or b"")
                if size > PIECE or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([keys[start : i + 1].cast(schema[0].type), pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=schema)
                    names, texts, start, size = [], [], i + 1, 0

    return files.select(key, content).mapInArrow(run, named)


def encoded(rows: DataFrame, key: str, text: str, charset: str) -> DataFrame:
    """(key, content, text): the text in the charset that its row names, less the characters that this lacks, and what is left of it. Null if either is null."""
    named = T.StructType([rows.schema[key], T.StructField("content", T.BinaryType()), T.StructField("text", T.StringType())])
    schema = to_arrow_schema(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, made, start, size = batch.column(0), [], 0, 0
            for i, (value, name) in enumerate(zip(batch.column(1), batch.column(2))):
                t, c = value.as_py(), name.as_py()
                data = None if t is None or c is None else t.encode(c, "ignore")
                made.append((data, None if data is None else data.decode(c)))
                size += len(data or b"")
                if size > PIECE or i + 1 == batch.num_rows:  # not a whole batch's texts twice over
                    yield pa.RecordBatch.from_arrays([keys[start : i + 1].cast(schema[0].type), pa.array([d for d, _ in made], pa.binary()), pa.array([x for _, x in made], pa.string())], schema=schema)
                    made, start, size = [], i + 1, 0

    return rows.select(key, text, charset).mapInArrow(run, named)
