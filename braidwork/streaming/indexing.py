"""Incremental indexing: events carry ids only; the current source row decides, so order does not matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidwork.operators.chat import index_feed, search_messages
from braidwork.sources import changes

Source = Callable[[], tuple[DataFrame, DataFrame]]


def event_changes(events: DataFrame, messages: DataFrame, streams: DataFrame, version: int) -> DataFrame:
    """Changes for events (message_id, action). Whatever the actions of an id and their order, its source row decides: it is indexed if it is there, and its document goes if it is gone, deleted or of another type."""
    ids = events.select("message_id").where("message_id is not null").distinct()
    rows = search_messages(index_feed(messages, streams)).join(ids, "message_id", "left_semi")
    gone = ids.join(rows.select("message_id"), "message_id", "left_anti")
    return changes.together(changes.upserts(rows, version), changes.deletes(gone, version))


def index_stream(events: DataFrame, path: str, source: Source, checkpoint: str) -> StreamingQuery:
    """A streaming query from events to the log at ``path``. A batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        messages, streams = source()
        changes.append(event_changes(batch, messages, streams, changes.version_now()), path, f"stream-{number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reindex_stream(messages: DataFrame, streams: DataFrame, path: str, site_id: int, sid: int) -> None:
    """All of a stream's rows anew, so channel types are fresh and deleted rows go."""
    now = changes.version_now()
    one = messages.sparkSession.range(1).select(F.lit(site_id).cast("long").alias("site_id"), F.lit(sid).cast("long").alias("sid"))
    rows = search_messages(index_feed(messages, streams, site_id, [sid]))
    changes.append(changes.together(changes.upserts(rows, now), changes.stream_deletes(one, now)), path, f"stream-of-{site_id}-{sid}-{now}")


def backfill(messages: DataFrame, streams: DataFrame, path: str, job: str, since: tuple[object, int] | None = None, version: int | None = None) -> dict[str, int]:
    """All rows after ``since`` (time, key) in one partitioned scan and one write; counts of rows fetched and indexed.

    A job that failed leaves no committed folder and is run again; one that is repeated replaces its folder."""
    feed = index_feed(messages, streams)
    if since is not None:
        at, key = F.lit(since[0]).cast("timestamp_ntz"), since[1]
        feed = feed.where((F.col("messagetime") > at) | ((F.col("messagetime") == at) & (F.col("smsgid") > key)))
    fetched, indexed = Observation(), Observation()
    rows = search_messages(feed.observe(fetched, F.count(F.lit(1)).alias("n"))).where("message_id is not null")
    written = changes.upserts(rows, changes.version_now() if version is None else version).observe(indexed, F.count(F.lit(1)).alias("n"))
    changes.append(written, path, f"job-{job}")
    return {"fetched": fetched.get["n"], "indexed": indexed.get["n"]}


def embedded(docs: DataFrame, model: Callable[[list[str]], list[list[float]]], version: str, *, text: str = "text", size: int = 64) -> DataFrame:
    """Adds embedding and embedding_version. ``model`` gets at most ``size`` texts at once; a null text has a null vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), size):
                part = f.iloc[k : k + size]
                known = part[text].notna()
                vectors = iter(model(part.loc[known, text].tolist()) if known.any() else [])
                yield part.assign(embedding=[next(vectors) if has else None for has in known])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{fields}, embedding array<double>").withColumn("embedding_version", F.when(F.col("embedding").isNotNull(), F.lit(version)))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events by window and type, for batches and streams."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
