"""Tables of a relational database: partitioned reads by a whole-number key, hosts tried in turn, inserts that can be repeated.

The database counts the rows of equal steps of the key, crowded steps again in finer ones, and partitions are cut from these
counts, so that gaps and crowds in the key don't make uneven tasks. For each finer count some ``STEPS`` numbers a partition come to the driver. Filters on the frame and
its choice of columns are pushed into each partition's statement by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = 16


def reachable(spark: SparkSession, urls: Sequence[str], table: str, properties: dict[str, str] | None = None) -> str:
    """The first address that answers for the table. It is asked once, when a read or write is planned; a host that is lost
    later fails the job, which then finds the next one when it is run again."""
    tried: list[str] = []
    for url in urls:
        try:
            spark.read.jdbc(url, table, properties=properties or {}).schema  # noqa: B018 reads the table's columns
        except (Py4JJavaError, PySparkException) as e:
            tried.append(f"{url.split(';')[0]}: {str(e).splitlines()[0]}")
            continue
        return url
    raise ConnectionError("no host answers; " + "; ".join(tried))


def _quoted(spark: SparkSession, url: str, name: str) -> str:
    """As Spark itself quotes a column for this kind of database."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)  # type: ignore[union-attr]


def cuts(counts: list[tuple[int, int]], parts: int) -> list[int]:
    """First keys of all parts but the first, from (first key of a step, rows) in order: at most ``parts`` of about equal rows."""
    total, seen, out = sum(n for _, n in counts), 0, []
    for first, n in counts:
        if seen and len(out) + 1 < parts and seen * parts >= total * (len(out) + 1):
            out.append(first)
        seen += n
    return out


def ranges(key: str, firsts: list[int]) -> list[str]:
    """Conditions that each row meets one of, null keys too."""
    if not firsts:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(firsts, firsts[1:])]
    return [f"{key} < {firsts[0]} OR {key} IS NULL", *inner, f"{key} >= {firsts[-1]}"]


def _counts(ask: Callable[[str], DataFrame], table: str, key: str, low: int, high: int, parts: int, most: int) -> list[tuple[int, int]]:
    """(first key, rows) of steps from low to high. A step of over ``most`` rows, of which there are ``parts`` at most, is
    counted again in finer steps, until it is one key."""
    step = (high - low) // (parts * STEPS) + 1
    counted = ask(f"SELECT b, COUNT(*) AS n FROM (SELECT ({key} - {low}) / {step} AS b FROM {table} WHERE {key} BETWEEN {low} AND {high}) t GROUP BY b")
    # A database may divide to a fraction: the pieces of a step are put together here.
    steps = counted.groupBy(F.floor(F.col(counted.columns[0])).cast("long").alias("b")).agg(F.sum(counted.columns[1]).alias("n")).orderBy("b")
    out: list[tuple[int, int]] = []
    for b, n in [(r["b"], int(r["n"])) for r in steps.collect()]:
        first = low + b * step
        fine = n > most and step > 1
        out += _counts(ask, table, key, first, min(high, first + step - 1), parts, most) if fine else [(first, n)]
    return out


def read(spark: SparkSession, urls: Sequence[str], table: str, key: str, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """The table in at most ``parts`` partitions of about equal numbers of rows.

    ``table`` is put into the statements as it is; ``key`` is a column as the table's schema names it, and is quoted."""
    url = reachable(spark, urls, table, properties)
    key = _quoted(spark, url, key)
    ask = lambda sql: spark.read.format("jdbc").options(**(properties or {})).option("url", url).option("query", sql).load()
    low, high, total = ask(f"SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT({key}) AS n FROM {table}").first()
    firsts: list[int] = []
    if low is not None and parts > 1:
        counts = _counts(ask, table, key, int(low), int(high), parts, int(total) // parts)
        firsts = cuts(counts, parts)
    return spark.read.jdbc(url, table, predicates=ranges(key, firsts), properties=properties or {})


def insert_missing(rows: DataFrame, urls: Sequence[str], table: str, key: str, parts: int = 8, properties: dict[str, str] | None = None) -> None:
    """Inserts the rows whose key the table doesn't have yet, one of each key, and makes the table if there is none.

    A run that failed half-way is run again and adds what is missing. One writer at a time; a unique key in the
    database turns a second attempt of a task into an error instead of a second row. Rows with a null key are refused."""
    spark, properties = rows.sparkSession, properties or {}
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null in some rows")
    one = rows.dropDuplicates([key])
    try:
        url = reachable(spark, urls, table, properties)
    except ConnectionError:
        _first_write(one, urls, table, parts, properties)
        return
    bounds = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if bounds is None or bounds["low"] is None:
        return
    there = read(spark, [url], table, key, parts, properties).where(F.col(key).between(bounds["low"], bounds["high"])).select(F.col(key).alias("_there"))
    one.join(there, F.col(key) == F.col("_there"), "left_anti").coalesce(parts).write.jdbc(url, table, "append", properties)


def _first_write(rows: DataFrame, urls: Sequence[str], table: str, parts: int, properties: dict[str, str]) -> None:
    """Of a table that no host has: on the first host that takes it."""
    for n, url in enumerate(urls):
        try:
            rows.limit(0).write.jdbc(url, table, "error", properties)
        except (Py4JJavaError, PySparkException):
            if n + 1 == len(urls):
                raise
            continue
        rows.coalesce(parts).write.jdbc(url, table, "append", properties)
        return
