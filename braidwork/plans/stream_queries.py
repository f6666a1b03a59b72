"""Queries that run streams and jobs over the whole tables and read what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import conversation as c
from braidwork.sources import changes
from braidwork.sources import tables as t
from braidwork.sources.folders import shared_folder
from braidwork.streaming import backfill, stateful

from .registry import Registry

Q = Registry()


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"


def _arriving(s: SparkSession, d: str) -> DataFrame:
    """The messages as a stream; their times are read in UTC. A stream takes a single file by a pattern only."""
    turns = s.readStream.schema(t.table(s, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")
    rows = c.counted(t.messages_of(turns))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("messagetime"))
    return rows.select("sid", F.timestamp_micros(micros).alias("at"), "tokens", "smsgid")


def _boundaries(s: SparkSession, d: str) -> DataFrame:
    """All messages that the watermark has passed when the input ends: those of the last time still wait."""
    folder = _folder(s)
    out = stateful.boundaries(_arriving(s, d), "sid", "at", "tokens", "smsgid", "0 seconds")
    stateful.to_parquet(out, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return s.read.schema(out.schema).parquet(f"{folder}/rows").select("smsgid", "strength")


Q.add(
    "stream_boundaries", _boundaries,
    t.with_views(""", m AS (SELECT smsgid, messagetime AS ts, lag(messagetime) OVER (PARTITION BY sid ORDER BY messagetime, smsgid) AS b FROM messages)
      SELECT smsgid, CASE WHEN b IS NULL THEN 0 WHEN year(ts) * 12 + month(ts) <> year(b) * 12 + month(b) THEN 4 WHEN isoyear(ts) * 100 + weekofyear(ts) <> isoyear(b) * 100 + weekofyear(b) THEN 3
      WHEN CAST(ts AS DATE) <> CAST(b AS DATE) THEN 2 WHEN date_sub('second', b, ts) >= 1800 THEN 1 ELSE 0 END AS strength FROM m WHERE ts < (SELECT max(ts) FROM m)""", "messages"),
)


def _closed(s: SparkSession, d: str) -> DataFrame:
    """By conversation that was silent for a day before the input ended: its messages, and whether their batches are those of the batch operator."""
    folder = _folder(s)
    out = stateful.closed_batches(_arriving(s, d), "sid", "at", "tokens", "smsgid", 400, 1440, "0 seconds")
    stateful.to_parquet(out, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    got = s.read.schema(out.schema).parquet(f"{folder}/rows").select("sid", "smsgid", F.col("batch").alias("got"))
    want = c.time_aligned_batches(c.counted(t.messages(s, d)).select("sid", "messagetime", "tokens", "smsgid"), "sid", "messagetime", "tokens", 400, "smsgid").select("smsgid", "batch")
    return got.join(want, "smsgid", "left").groupBy("sid").agg(F.count("*").alias("n"), F.min(F.coalesce(F.col("got") == F.col("batch"), F.lit(False))).alias("same"))


Q.add(
    "stream_batches", _closed,
    t.with_views("SELECT sid, count(*) AS n, TRUE AS same FROM messages GROUP BY sid HAVING max(messagetime) + INTERVAL 1 DAY <= (SELECT max(messagetime) FROM messages)", "messages"),
)


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """The log of a backfill that was ended after two pages of about a fifth of the feed, and run again."""
    folder, m, streams = _folder(s), t.messages(s, d), t.streams(s, d)
    fifth = -(-m.count() // 5)
    for pages in (2, None):
        backfill.run(m, streams, f"{folder}/log", f"{folder}/jobs", "all", page_rows=fifth, most_pages=pages)
    log = changes.read_log(s, f"{folder}/log")
    assert log is not None
    return changes.current(log, "message_id").select("message_id", "sid", "text")


Q.add(
    "backfill_resumed", _resumed,
    t.with_views("SELECT smsgid AS message_id, sid, coalesce(message, '') AS text FROM messages JOIN streams ON sid = streams.id WHERE msgtype IN (0, 20) AND NOT messages.isdeleted", "messages", "streams"),
)
