"""Web archives: writing, normalising monolithic gzip, and reading back by a sidecar offset index.

Three Spark steps, each handing on a table of files:
``write_monolithic`` writes the records of a partition into archives that are one gzip stream each;
``normalise`` inflates such a stream once, front to back, rewrites every record as a gzip member of its own and
writes a sidecar index of (offset, length, record id) lines; ``read_records`` seeks by the index.

Every attempt of a task writes under a name of its own, and only names that a finished task returned are read,
so lost executors leave unused files at worst. Files are reached through pyarrow's file systems, under a root
that all executors share.

Defined results: null html is an empty payload; of equal payloads of at least ``MIN_REVISIT`` bytes the smallest
page_id is response (so is a row that repeats it), the others are revisits of it; payloads whose page_ids are all
null are responses; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only_listed, shared_dir

MIN_REVISIT = 100
#: Bytes of records after which an archive is closed; an archive is one task's work when normalised and read.
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
#: Archives are dealt to so many tasks a core at most; with more of them a task takes several, one after the other.
WAVES = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", root if ":/" in root else f"file://{root}")))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def header(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {header(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"] if revisit else []
    lines += [] if page_id is None else [f"X-Page: {page_id}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:]) if k}


def decided(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to (null: response). Only payloads that occur twice are shuffled."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.octet_length("payload") >= min_revisit)
    twice = cut(rows.where("large").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null").drop("n"))
    flagged = only_listed(rows, "digest", twice, flag=True)
    alone = flagged.where("not listed or not large").withColumn("first", F.lit(None).cast("long"))
    met = flagged.where("listed and large").join(twice, "digest", "left").select(*alone.columns)
    return alone.union(met).select("page_id", "url", "payload", "digest", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def write_monolithic(rows: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``decided`` rows, as (archive, n_records). Each is a single gzip stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        out: BinaryIO | None = None
        name, n, size, squeeze = "", 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size, squeeze = f"{base}/raw-{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out = store.open_output_stream(name, compression=None)
                made = record(page_id, url, payload, digest, refers_to, refers_to is not None)
                out.write(squeeze.compress(made))
                n, size = n + 1, size + len(made)
                if size >= archive_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["archive", "n_records"])

    return rows.mapInArrow(write, "archive string, n_records long")


def inflated_records(source: BinaryIO, piece: int = 1 << 20) -> Iterator[bytes]:
    """Records of a gzip file, be it one stream or many members, inflated once from front to back. Holds one record and at most ``piece`` bytes beyond it, however far the stream is squeezed."""
    inflate, held = zlib.decompressobj(31), bytearray()
    need = None
    while data := source.read(piece):
        while data:
            held += inflate.decompress(data, piece)
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            start = 0
            while True:
                if need is None:
                    end = held.find(b"\r\n\r\n", start)
                    if end < 0:
                        break
                    need = end + 4 - start + int(fields(bytes(held[start:end]))["content-length"]) + 4
                if len(held) - start < need:
                    break
                yield bytes(held[start : start + need])
                start, need = start + need, None
            del held[:start]
    if held:
        raise ValueError("the archive ends within a record")


def normalise(archives: DataFrame, root: str) -> DataFrame:
    """Rewrites each of ``archives`` (archive): as (archive, index, n_records), a gzip member a record and a line of JSON a record."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        done: list[tuple[str, str, int]] = []
        for batch in batches:
            for old in batch.column(0).to_pylist():
                name = f"{base}/norm-{uuid.uuid4().hex}"
                at = n = 0
                with store.open_input_file(old) as source, store.open_output_stream(f"{name}.warc.gz", compression=None) as out, store.open_output_stream(f"{name}.idx", compression=None) as index:
                    for made in inflated_records(source):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = squeeze.compress(made) + squeeze.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "id": fields(made[: made.index(b"\r\n\r\n")])["warc-record-id"]}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                done.append((f"{name}.warc.gz", f"{name}.idx", n))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64() if i == 2 else pa.string()) for i in range(3)], names=["archive", "index", "n_records"])

    return archives.select("archive").mapInArrow(rewrite, "archive string, index string, n_records long")


def read_records(archives: DataFrame, root: str) -> DataFrame:
    """A row a record of ``archives`` (archive, index): page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset. Each record is inflated by itself; the digest of a response is taken anew from its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(root)
        for batch in batches:
            for archive, index in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                with store.open_input_file(index) as f:
                    places = [json.loads(x) for x in f.read().splitlines()]
                rows: list[tuple[int | None, int, str, str, int | None, str, int]] = []
                with store.open_input_file(archive) as f:
                    for p in places:
                        f.seek(p["offset"])
                        made = zlib.decompress(f.read(p["length"]), 31)
                        end = made.index(b"\r\n\r\n")
                        head = fields(made[:end])
                        block = made[end + 4 : end + 4 + int(head["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = head["warc-type"] == "revisit"
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{archive} at {p['offset']}: the payload differs from its digest")
                        size = int(fields(http)["content-length"]) if revisit else len(payload)
                        rows.append((int(head["x-page"]) if "x-page" in head else None, size, digest, head["warc-type"], int(head["x-refers-to-page"]) if revisit else None, archive, p["offset"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"])

    return archives.select("archive", "index").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write, normalise and read back ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    if root is None:
        root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)  # type: ignore[union-attr]
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # type: ignore[union-attr]
    most = WAVES * spark.sparkContext.defaultParallelism
    dealt = lambda files: files.repartition(min(max(1, files.count()), most))
    raw = cut(write_monolithic(decided(pages), root))
    normal = cut(normalise(dealt(raw), root))
    return read_records(dealt(normal), root)
