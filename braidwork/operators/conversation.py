"""Conversations: cleaning, time-aligned batches, interval algebra of stored summaries, segments."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions.text import clean_message, is_noise, token_estimate

IDLE_MINUTES = 30
TOLERANCE, LEAST_SHARE = 0.30, 0.5
CHANGES = {"month": 4, "week": 3, "day": 2, "idle": 1}


def without_noise(rows: DataFrame, message: str = "message") -> DataFrame:
    """Cleaned messages that say something; other columns stay."""
    out = rows.withColumn("_clean", clean_message(F.col(message))).where(~is_noise(F.col("_clean"), F.col(message)))
    return out.select(*[F.col("_clean").alias(c) if c == message else F.col(c) for c in rows.columns])


def boundary_strength(rows: DataFrame, partition: str, at: str, *ties: str) -> DataFrame:
    """Adds strength: how much the calendar changes from the row before."""
    t, before = F.col(at), F.lag(at).over(Window.partitionBy(partition).orderBy(at, *ties))
    month = lambda x: F.year(x) * 12 + F.month(x)
    week = lambda x: F.extract(F.lit("YEAROFWEEK"), x) * 100 + F.weekofyear(x)
    idle = F.timestamp_diff("SECOND", F.col("_before"), t) >= IDLE_MINUTES * 60
    p = F.col("_before")
    strength = (
        F.when(p.isNull() | t.isNull(), 0).when(month(t) != month(p), CHANGES["month"]).when(week(t) != week(p), CHANGES["week"]).when(F.to_date(t) != F.to_date(p), CHANGES["day"]).when(idle, CHANGES["idle"]).otherwise(0)
    )
    return rows.withColumn("_before", before).withColumn("strength", strength).drop("_before")


def cumulative_tokens(rows: DataFrame, partition: str, tokens: Column, *order: str) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("tokens", tokens).withColumn("cumulative", F.sum("tokens").over(w))


def _cut(tokens: list[int], strength: list[int], share: float, target: int) -> int:
    """How many of the next messages make a batch; the last one given is there for the boundary before it only."""
    cuts, total = [], 0
    for i in range(len(tokens) - 1):
        total += tokens[i]
        if total > target:
            break
        cuts.append((i + 1, total))
    for low, high in ((share * (1 - TOLERANCE), min(target, share * (1 + TOLERANCE))), (share * LEAST_SHARE, target)):
        near = [c for c in cuts if low <= c[1] <= high]
        if near:
            return max(near, key=lambda c: (strength[c[0]], -abs(c[1] - share), -c[0]))[0]
    return cuts[-1][0] if cuts else 1


def split_batches(tokens: list[int], strength: list[int], target: int) -> list[int]:
    """Batch number of each message. A batch holds at most ``target`` tokens, unless one message is larger.

    ``strength[i]`` is the boundary before message i. Equal shares are aimed at; of the cuts near the share the
    one at the strongest boundary wins, then the nearest, then the first."""
    out, start, batch, left = [0] * len(tokens), 0, 0, sum(tokens)
    while start < len(tokens):
        end = len(tokens) if left <= target else start + _cut(tokens[start:], strength[start:], left / math.ceil(left / target), target)
        out[start:end] = [batch] * (end - start)
        left -= sum(tokens[start:end])
        start, batch = end, batch + 1
    return out


def _batches_in_order(frames: Iterator[pa.RecordBatch], tokens: str, target: int) -> Iterator[pa.RecordBatch]:
    """``split_batches`` of conversations that come one after the other: holds back no more rows than one cut looks at."""
    held, batch, left, rest = None, 0, 0, 0
    for frame in frames:
        held = pa.Table.from_batches([frame]) if held is None else pa.concat_tables([held, pa.Table.from_batches([frame])])
        size, strength, total, rows = (held.column(c).to_pylist() for c in (tokens, "strength", "_total", "_rows"))
        out: list[int] = []
        while len(out) < len(size):
            at = len(out)
            if not rest:
                batch, left, rest = 0, total[at], rows[at]
            if left <= target:
                n, last = min(rest, len(size) - at), True
            else:
                end, ahead = at, 0
                while end < min(at + rest, len(size)) and ahead <= target:
                    ahead, end = ahead + size[end], end + 1
                if ahead <= target and end < at + rest:
                    break
                n, last = _cut(size[at:end], strength[at:end], left / math.ceil(left / target), target), False
            out += [batch] * n
            left, rest = left - sum(size[at : at + n]), rest - n
            batch += not last
        done = held.slice(0, len(out)).append_column("batch", pa.array(out, pa.int32())).drop_columns(["_total", "_rows", "_at"])
        yield from done.combine_chunks().to_batches()
        held = held.slice(len(out)).combine_chunks()


def time_aligned_batches(rows: DataFrame, conversation: str, at: str, tokens: str, target: int, *ties: str) -> DataFrame:
    """Adds strength and batch to (conversation, time, tokens, ties).

    A conversation is walked in order, as each cut depends on the one before; a task holds the rows of about
    ``target`` tokens and no whole conversation, however long. Where a time is unknown, the ties alone give the order;
    null tokens count as none."""
    whole = Window.partitionBy(conversation)
    sized = rows.select(conversation, at, F.coalesce(tokens, F.lit(0)).cast("long").alias(tokens), *ties)
    ready = boundary_strength(sized, conversation, at, *ties).withColumns(
        {"_at": F.when(F.min(F.col(at).isNotNull()).over(whole), F.col(at)), "_total": F.sum(tokens).over(whole), "_rows": F.count("*").over(whole)}
    )
    schema = T.StructType([*[f for f in ready.schema if f.name not in ("_at", "_total", "_rows")], T.StructField("batch", T.IntegerType())])
    in_order = ready.repartition(conversation).sortWithinPartitions(conversation, "_at", *ties)
    return in_order.mapInArrow(lambda frames: _batches_in_order(frames, tokens, target), schema)


def pack_adjacent(sizes: list[int], limit: int) -> list[int]:
    """Group of each size: a new group where the limit would be passed and the group isn't empty."""
    out, group, total, n = [], 0, 0, 0
    for s in sizes:
        if n and total + s > limit:
            group, total, n = group + 1, 0, 0
        out.append(group)
        total, n = total + s, n + 1
    return out


def _packs_in_order(frames: Iterator[pa.RecordBatch], size: str, limit: int) -> Iterator[pa.RecordBatch]:
    """``pack_adjacent`` of partitions that come one after the other; only the open pack's sum is kept."""
    group, total, n = 0, 0, 0
    for frame in frames:
        out = []
        for first, s in zip(frame.column("_first").to_pylist(), frame.column(size).to_pylist()):
            if first:
                group, total, n = 0, 0, 0
            if n and total + (s or 0) > limit:
                group, total, n = group + 1, 0, 0
            out.append(group)
            total, n = total + (s or 0), n + 1
        yield frame.append_column("pack", pa.array(out, pa.int32())).drop_columns(["_first"])


def adjacent_groups(rows: DataFrame, partition: str, order: str, size: str, limit: int, *more: str) -> DataFrame:
    """(partition, order, size, more, pack): packs of a partition's rows in order. No partition is held as a whole; a null size counts as 0."""
    w = Window.partitionBy(partition).orderBy(order, size)
    ready = rows.select(partition, order, size, *more, (F.row_number().over(w) == 1).alias("_first"))
    schema = T.StructType([*[f for f in ready.schema if f.name != "_first"], T.StructField("pack", T.IntegerType())])
    in_order = ready.repartition(partition).sortWithinPartitions(partition, order, F.desc("_first"), size)
    return in_order.mapInArrow(lambda frames: _packs_in_order(frames, size, limit), schema)


def latest_by_interval(summaries: DataFrame, ref: str = "ref_id") -> DataFrame:
    """One summary of equal intervals: the largest id."""
    w = Window.partitionBy(ref, "start_date", "end_date").orderBy(F.desc("id"))
    return summaries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def not_contained(summaries: DataFrame, ref: str = "ref_id") -> DataFrame:
    """Intervals that lie in no strictly longer one of their ref.

    In order of (start, longest first) an interval is contained if an earlier one reaches its end, so a running
    maximum answers it without a self-join; equal intervals don't contain each other."""
    w = Window.partitionBy(ref).orderBy("start_date", F.desc("end_date")).rowsBetween(Window.unboundedPreceding, -1)
    distinct = summaries.select(ref, "start_date", "end_date").distinct().withColumn("_reach", F.max("end_date").over(w))
    outer = distinct.where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end_date"))).drop("_reach")
    return summaries.join(outer, [ref, "start_date", "end_date"], "left_semi")


def coverage_gaps(intervals: DataFrame, window_start: Column, window_end: Column, ref: str = "ref_id") -> DataFrame:
    """(ref, gap_start, gap_end): what of the window the intervals leave open, ends included, to the second.

    Islands merge where they overlap or touch; gaps shorter than a second are dropped."""
    one = F.expr("INTERVAL '1' SECOND")
    cut = intervals.select(ref, F.greatest("start_date", window_start).alias("s"), F.least("end_date", window_end).alias("e")).where("s <= e")
    before = F.max("e").over(Window.partitionBy(ref).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    open_ = cut.withColumn("reach", before)
    inner = open_.select(ref, F.when(F.col("reach").isNull(), window_start).otherwise(F.col("reach") + one).alias("gap_start"), (F.col("s") - one).alias("gap_end"), (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).alias("new")).where("new").drop("new")
    tail = cut.groupBy(ref).agg(F.max("e").alias("e")).select(ref, (F.col("e") + one).alias("gap_start"), window_end.alias("gap_end"))
    return inner.union(tail).where("gap_start <= gap_end")


def uncovered(messages: DataFrame, gaps: DataFrame, ref: str, at: str) -> DataFrame:
    """Messages within a gap (ref, gap_start, gap_end) of their ref, the delta that a stored summary lacks.

    Gaps don't overlap, so the last one that has begun decides: one union and one window, no range join."""
    begins = gaps.select(F.col("ref_id").alias("_ref"), F.col("gap_start").alias("_at"), F.col("gap_end").alias("_end"))
    rows = messages.select(F.struct(*messages.columns).alias("_m"), F.col(ref).alias("_ref"), F.col(at).alias("_at"))
    w = Window.partitionBy("_ref").orderBy("_at", F.col("_m").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(begins, allowMissingColumns=True).withColumn("_end", F.last("_end", ignorenulls=True).over(w))
    return both.where(F.col("_m").isNotNull() & (F.col("_at") <= F.col("_end"))).select("_m.*")


def extended(summaries: DataFrame, messages: DataFrame, window_start: Column, window_end: Column, ref: str, at: str) -> DataFrame:
    """(ref_id, id, start_date, end_date, n, added): the latest stored summary of each ref, moved to the window's end by
    what its gaps hold. ``added`` counts those messages; where there are none the summary stays as it is.

    Summaries have id, ref_id, start_date, end_date and n (messages)."""
    inside = summaries.where((F.col("start_date") <= window_end) & (F.col("end_date") >= window_start))
    delta = uncovered(messages, coverage_gaps(inside, window_start, window_end), ref, at).groupBy(F.col(ref).alias("ref_id")).agg(F.count("*").alias("added"))
    latest = inside.groupBy("ref_id").agg(F.max_by(F.struct("id", "start_date", "end_date", "n"), F.struct("end_date", "id")).alias("s"))
    added = F.coalesce("added", F.lit(0).cast("long"))
    end = F.when(added > 0, F.greatest("s.end_date", window_end)).otherwise(F.col("s.end_date"))
    return latest.join(delta, "ref_id", "left").select("ref_id", "s.id", "s.start_date", end.alias("end_date"), (F.col("s.n") + added).alias("n"), added.alias("added"))


#: Of a payload, what is not shown to a model.
INTERNAL = ("start", "end", "extra_data", "condensed", "unavailable")
#: Limits of a request.
MAX_DAYS, MAX_MESSAGES = 93, 10_000


def payload(segments: DataFrame) -> DataFrame:
    return segments.drop(*INTERNAL)


def has_chats(segments: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, has_chats): whether a segment of chats (type, n) has a message; null counts are none."""
    return segments.groupBy(key).agg(F.max(F.coalesce((F.col("type") == "chats") & (F.col("n") > 0), F.lit(False))).alias("has_chats"))


def storable(*special: Column) -> Column:
    """Whether a request's summary is kept: none of topic, buddy, context, unread and count is asked for (null, empty, 0 or false)."""
    asked = [~F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "false") for c in special]
    return ~reduce(or_, asked, F.lit(False))


def request_error(start: Column, end: Column, n_messages: Column) -> Column:
    """Why a request is refused; null if it isn't."""
    return (
        F.when(start > end, "start after end")
        .when(F.timestamp_diff("SECOND", start, end) > MAX_DAYS * 86_400, f"more than {MAX_DAYS} days")
        .when(n_messages > MAX_MESSAGES, f"more than {MAX_MESSAGES} messages")
    )


def segments(summaries: DataFrame, chats: DataFrame) -> DataFrame:
    """Both kinds (ref_id, start, n, text) with their type; those of a ref lie together, in order of start."""
    both = summaries.withColumn("type", F.lit("summary")).unionByName(chats.withColumn("type", F.lit("chats")))
    return both.repartition("ref_id").sortWithinPartitions("ref_id", "start", "type")


def segment_metadata(rows: DataFrame, key: str, user: str, at: str, *ties: str) -> DataFrame:
    """Messages, participants in order of first appearance, and seconds from first to last."""
    per = rows.groupBy(key, user).agg(F.min(F.struct(at, *ties)).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return per.groupBy(key).agg(
        F.sum("n").alias("n_messages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", user))), lambda x: x[user].cast("string")), ", ").alias("participants"),
        F.timestamp_diff("SECOND", F.min(f"first.{at}"), F.max("last")).alias("seconds"),
    )


def token_limits(max_input: Column, margin: float, instructions: int, max_output: Column, cap: int, target: int) -> tuple[Column, Column]:
    """(tokens of a single pass, tokens of a batch)"""
    usable = F.floor(max_input * (1 - margin)) - instructions - max_output
    single = F.greatest(F.lit(1), F.least(usable, F.lit(cap)))
    return single, F.greatest(F.lit(1), F.least(F.lit(target), single))


def merged_date_range(first: Column, last: Column) -> Column:
    return F.concat(F.element_at(F.split(first, " - "), 1), F.lit(" - "), F.element_at(F.split(last, " - "), -1))


UNAVAILABLE = "[unavailable]"


def map_reduce(batches: DataFrame, conversation: str, text: str, summarise: Callable[[str], str], limit: int, rounds: int = 4, attempts: int = 2) -> DataFrame:
    """(conversation, summary, unavailable): a summary of each batch, adjacent ones merged until one is left or the rounds end.

    ``batches`` has conversation, batch and text, each batch within the limit. A batch that fails all attempts is
    unavailable; a conversation of such batches only has a null summary. A round is a shuffle, so only texts that
    are merged meet in a task; what the last round leaves is joined to one summary."""

    def call(t: str) -> str | None:
        for _ in range(attempts):
            try:
                return summarise(t)
            except Exception:  # noqa: BLE001 a model may fail in any way
                continue
        return None

    def condense(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{text: [call(t) for t in f[text]]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            merged = [t if n < 2 else UNAVAILABLE if (r := call(t)) is None else r for t, n in zip(f[text], f["n"])]
            yield f.assign(**{text: merged}).drop(columns="n")

    kind = f"{conversation} {batches.schema[conversation].dataType.simpleString()}"
    now = batches.select(conversation, "batch", text).mapInPandas(condense, f"{kind}, batch int, {text} string")
    lost = F.sum(F.col(text).isNull().cast("int")).over(Window.partitionBy(conversation)).cast("int")
    # The first batch stays even if it has no summary: of size 0 it changes no pack, and keeps its conversation.
    now = now.withColumn("unavailable", lost).where(F.col(text).isNotNull() | (F.col("batch") == 0))
    in_order = F.transform(F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct("batch", text)))), lambda b: b[text])
    for _ in range(rounds):
        sized = now.withColumn("_size", F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)))
        packs = adjacent_groups(sized, conversation, "batch", "_size", limit, text, "unavailable").groupBy(conversation, "pack")
        parts = packs.agg(in_order.alias("t"), F.max("unavailable").alias("unavailable"))
        joined = F.when(F.size("t") > 0, F.array_join("t", "\n"))
        now = parts.select(conversation, F.col("pack").alias("batch"), joined.alias(text), "unavailable", F.size("t").alias("n")).mapInPandas(merge, f"{kind}, batch int, {text} string, unavailable int")
    whole = now.groupBy(conversation).agg(in_order.alias("t"), F.max("unavailable").alias("unavailable"))
    return whole.select(conversation, F.when(F.size("t") > 0, F.array_join("t", "\n")).alias("summary"), "unavailable")


def counted(rows: DataFrame, message: str = "message") -> DataFrame:
    return rows.withColumn("tokens", F.greatest(token_estimate(F.col(message)), F.lit(1).cast("long")))
