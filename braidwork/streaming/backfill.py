"""Backfill in pages of (time, key), with a checkpoint after each page, so that a job that died goes on where it was.

A job first plans its pages: it cuts the feed's times at quantiles and saves the cuts. A page is then one scan, whose
bounds on the time reach the files, and one write of a folder of the log. The checkpoint is saved after the page's
write; a page that was written but not saved is written again into its own folder, which changes nothing. Rows of
one time are never parted, so a page is as large as the rows of its times; it is written by all tasks, whatever its size.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.chat import index_feed, search_messages
from braidwork.sources import changes

SCHEMA = "job string, since timestamp_ntz, since_key long, cuts array<timestamp_ntz>, page int, at timestamp_ntz, key long, fetched long, indexed long, done boolean"
MOST_PAGES = 10_000


@dataclass(frozen=True)
class Checkpoint:
    """Of a job. ``page`` pages are written, up to (at, key); the last page goes from the last cut to the end."""

    job: str
    since: datetime | None
    since_key: int | None
    cuts: list[datetime]
    page: int = 0
    at: datetime | None = None
    key: int | None = None
    fetched: int = 0
    indexed: int = 0
    done: bool = False


def saved(spark: SparkSession, path: str, job: str) -> Checkpoint | None:
    """The checkpoint of a job from the log of checkpoints at ``path``; None if it has none or was cleared."""
    log = changes.read_log(spark, path)
    if log is None:
        return None
    row = changes.current(log, "job").where(F.col("job") == job).select(*Checkpoint.__dataclass_fields__).first()
    return None if row is None else Checkpoint(**row.asDict())


def save(spark: SparkSession, path: str, c: Checkpoint) -> None:
    """One row in a folder of the job and the page: a page's checkpoint that is saved again replaces itself."""
    row = spark.createDataFrame([tuple(asdict(c)[f] for f in Checkpoint.__dataclass_fields__)], SCHEMA).coalesce(1)
    changes.append(changes.upserts(row, changes.version_now()), path, f"{c.job}-{c.page}")


def clear(spark: SparkSession, path: str, job: str) -> None:
    """The job begins anew when it is next run."""
    row = spark.createDataFrame([(job,)], "job string").coalesce(1)
    changes.append(changes.deletes(row, changes.version_now()), path, f"{job}-cleared")


def _after(feed: DataFrame, at: datetime | None, key: int | None) -> DataFrame:
    """A null time belongs to the beginning: it is there if there is no ``at``."""
    if at is None:
        return feed
    t = F.lit(at).cast("timestamp_ntz")
    return feed.where((F.col("messagetime") > t) | ((F.col("messagetime") == t) & (F.col("smsgid") > key)))


def _plan(feed: DataFrame, page_rows: int) -> list[datetime]:
    """Times at which pages of about ``page_rows`` rows end; the number of pages is bounded, their size isn't."""
    n = feed.count()
    pages = min(MOST_PAGES, -(-n // page_rows))
    if pages < 2:
        return []
    shares = [k / pages for k in range(1, pages)]
    micros = F.unix_micros(F.col("messagetime").cast("timestamp"))
    cuts = feed.agg(F.percentile_approx(micros, shares, max(10_000, 10 * pages)).alias("c"))
    times = cuts.select(F.array_sort(F.array_distinct(F.transform("c", lambda c: F.timestamp_micros(c).cast("timestamp_ntz")))).alias("c"))
    return list(times.first()["c"] or [])


def run(
    messages: DataFrame, streams: DataFrame, path: str, checkpoints: str, job: str, *, page_rows: int = 1_000_000, since: tuple[datetime, int] | None = None, most_pages: int | None = None
) -> Checkpoint:
    """Writes the index feed after ``since`` to the log at ``path`` and returns the checkpoint, ``done`` if nothing is left.

    A saved job goes on with its own ``since`` and cuts, whatever is given now; one that is done does nothing until it is
    cleared. Rows that come behind a written page while the job runs are the event stream's. ``most_pages`` ends the run after so many
    pages. Rows without a time belong to the first page of a job without ``since``; rows without an id are counted as fetched, not as indexed."""
    spark = messages.sparkSession
    feed = index_feed(messages, streams)
    c = saved(spark, checkpoints, job)
    if c is None:
        at, key = since or (None, None)
        c = Checkpoint(job, at, key, _plan(_after(feed, at, key), page_rows), at=at, key=key)
        save(spark, checkpoints, c)
    written = 0
    while not c.done and (most_pages is None or written < most_pages):
        c = _page(spark, feed, path, c)
        save(spark, checkpoints, c)
        written += 1
    return c


def _page(spark: SparkSession, feed: DataFrame, path: str, c: Checkpoint) -> Checkpoint:
    last = c.page >= len(c.cuts)
    low, high = (c.cuts[c.page - 1] if c.page else None), (None if last else c.cuts[c.page])
    rows = feed if low is None else feed.where(F.col("messagetime") > F.lit(low).cast("timestamp_ntz"))
    rows = _after(rows, c.since, c.since_key)
    if high is not None:
        within = F.col("messagetime") <= F.lit(high).cast("timestamp_ntz")
        rows = rows.where(within if c.page or c.since is not None else within | F.col("messagetime").isNull())
    fetched, indexed = Observation(), Observation()
    end = F.max(F.when(F.col("messagetime").isNotNull(), F.struct("messagetime", "smsgid"))).alias("end")
    docs = search_messages(rows.observe(fetched, F.count(F.lit(1)).alias("n"), end)).where("message_id is not null")
    counted = changes.upserts(docs, changes.version_now()).observe(indexed, F.count(F.lit(1)).alias("n"))
    changes.append(counted, path, f"job-{c.job}-{c.page}")
    n, m, reached = fetched.get["n"], indexed.get["n"], fetched.get["end"]
    at, key = (c.at, c.key) if reached is None else (reached["messagetime"], reached["smsgid"])
    return Checkpoint(c.job, c.since, c.since_key, c.cuts, c.page + 1, at, key, c.fetched + n, c.indexed + m, last)
