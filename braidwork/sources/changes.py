"""Keyed documents as a log of changes in plain Parquet: writes are appended, a reader keeps the last change of a key.

A write is a folder ``batch=<name>`` of the log and replaces the folder of that name, so a repeated write changes
nothing twice. Of two changes of a key the one with the later version counts; a write that has an upsert and a delete
of one key (those of events never do) deletes. A deleted stream hides what was written of it before; upserts of the same write stay.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

UPSERT, DELETE, DELETE_STREAM = "upsert", "delete", "delete_stream"
STREAM = ("site_id", "sid")


def upserts(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumns({"_action": F.lit(UPSERT), "_version": F.lit(version).cast("long")})


def deletes(keys: DataFrame, version: int) -> DataFrame:
    """``keys`` has the key columns, all others are null."""
    return keys.distinct().withColumns({"_action": F.lit(DELETE), "_version": F.lit(version).cast("long")})


def stream_deletes(streams: DataFrame, version: int) -> DataFrame:
    """``streams`` has site_id and sid."""
    return streams.select(*STREAM).distinct().withColumns({"_action": F.lit(DELETE_STREAM), "_version": F.lit(version).cast("long")})


def together(*changes: DataFrame) -> DataFrame:
    out = changes[0]
    for c in changes[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def current(log: DataFrame, *key: str, last: str = "updated_at") -> DataFrame:
    """The documents of a log. Equal versions of a key are told apart by ``last``, if there, then by content."""
    columns = [c for c in log.columns if not c.startswith("_") and c != "batch"]
    when = [F.col("_version"), F.col("_action") == DELETE, *([F.col(last)] if last in columns else []), F.xxhash64(*columns)]
    rows = log.where(F.col("_action") != DELETE_STREAM)
    kept = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in columns if c not in key], "_action", "_version"), F.struct(*when)).alias("_r"))
    docs = kept.select(*key, "_r.*").where(F.col("_action") == UPSERT)
    if set(STREAM) <= set(columns):
        gone = log.where(F.col("_action") == DELETE_STREAM).groupBy(*STREAM).agg(F.max("_version").alias("_gone"))
        docs = docs.join(gone, list(STREAM), "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_version")))
    return docs.select(*columns)


def append(changes: DataFrame, path: str, name: str) -> None:
    changes.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={name}")


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """None before the first write. Writes may have fewer columns than others."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def compact(spark: SparkSession, path: str, into: str, *key: str) -> None:
    """The documents of a log as the one write of another log, for readers to be pointed to."""
    log = read_log(spark, path)
    if log is not None:
        append(upserts(current(log, *key), version_now()), into, "compacted")


def version_now() -> int:
    """Nanoseconds since 1970. A log has one writer at a time, whose clock orders its writes."""
    return time.time_ns()


#: Content types that have an index.
INDEXES = {"messages": "messages", "sms": "sms", "files": "files", "channels": "channels", "users": "users"}


def index_of(content_type: str) -> str:
    try:
        return INDEXES[content_type]
    except KeyError:
        raise ValueError(f"no index for {content_type}") from None
