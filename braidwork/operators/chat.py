"""Chat and thread reads, access sets, index feeds and the message mapping."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.patterns import HIDDEN_TYPES, INDEXED_TYPES, PARENT_HIDDEN_TYPES, THREAD_TYPES
from braidwork.sources.tables import channel_type

AUTHOR = ("username", "siteid", "firstname", "lastname")
ROW = ("message", "messagetime", "archiveid", "sid")


def visible(msgtype: Column, hidden: tuple[int, ...] = HIDDEN_TYPES) -> Column:
    return ((msgtype < 200) | (msgtype > 300)) & ~msgtype.isin(*hidden)


def _authored(messages: DataFrame, persons: DataFrame, how: str = "inner") -> DataFrame:
    p = persons.select("im_archiveid", *[F.col(c).alias(f"p_{c}") for c in AUTHOR])
    return messages.join(p, messages.archiveid == p.im_archiveid, how)


def _rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*ROW, *[F.col(f"p_{c}").alias(c) for c in AUTHOR], *more)


def _chat(messages: DataFrame, streams: DataFrame, persons: DataFrame, sid: int | None) -> DataFrame:
    """Without a sid, of all streams."""
    m = messages.where(visible(F.col("msgtype")) & ~F.col("isdeleted"))
    m = m if sid is None else m.where(F.col("sid") == sid)
    s = streams.where(~F.col("isdeleted")).select(F.col("id").alias("stream"))
    return _authored(m.join(s, F.col("sid") == F.col("stream")), persons)


def _in_order(rows: DataFrame, one: bool, *by: str | Column) -> DataFrame:
    """Rows of one stream or thread in order; those of all streams are left as they come, as nobody reads them from end to end."""
    return rows.orderBy(*by) if one else rows


def by_duration(messages: DataFrame, streams: DataFrame, persons: DataFrame, start: datetime, end: datetime, sid: int | None = None) -> DataFrame:
    """Both ends included; of one stream in id order."""
    within = F.col("messagetime").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return _in_order(_rows(_chat(messages, streams, persons, sid).where(within), "id"), sid is not None, "id")


def last_n(messages: DataFrame, streams: DataFrame, persons: DataFrame, n: int, sid: int | None = None) -> DataFrame:
    """The newest n, oldest first."""
    return _rows(_chat(messages, streams, persons, sid), "id").orderBy(F.desc("id")).limit(n).orderBy("id")


def unread(messages: DataFrame, streams: DataFrame, members: DataFrame, persons: DataFrame, archive_id: int, sid: int | None = None) -> DataFrame:
    """Others' root messages after the reader's pointer; of one stream newest first."""
    me = members.where((F.col("archiveid") == archive_id) & ~F.col("isdeleted")).select(F.col("sid").alias("my_sid"), "lastreadsmsgid")
    rows = _chat(messages, streams, persons, sid).where((F.col("archiveid") != archive_id) & (F.col("commentvia") == 0))
    after = rows.join(me, (F.col("sid") == F.col("my_sid")) & (F.col("smsgid") > F.col("lastreadsmsgid")))
    return _in_order(_rows(after, "id"), sid is not None, F.desc("id"))


def parents(messages: DataFrame, streams: DataFrame, persons: DataFrame, smsgid: int | None = None) -> DataFrame:
    """Messages that can head a thread, with or without a known author; for one id newest first."""
    m = messages.where(visible(F.col("msgtype"), PARENT_HIDDEN_TYPES) & ~F.col("isdeleted") & (F.lit(True) if smsgid is None else F.col("smsgid") == smsgid))
    s = streams.where(~F.col("isdeleted")).select(F.col("id").alias("stream"))
    rows = _rows(_authored(m.join(s, F.col("sid") == F.col("stream")), persons, "left"), "smsgid")
    return _in_order(rows, smsgid is not None, F.desc("messagetime"), "smsgid")


def thread(messages: DataFrame, persons: DataFrame, root: int | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Replies that share or comment the root, without equal rows, with the root's id, in order of time; of all roots, in no order, if none is given."""
    m = messages.where(F.col("msgtype").isin(*THREAD_TYPES) & ~F.col("isdeleted"))
    if start is not None and end is not None:
        m = m.where(F.col("messagetime").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    both = m.select("*", F.explode(F.array_distinct(F.array("sharemsgid", "commentvia"))).alias("root")).where("root <> 0")
    both = both if root is None else both.where(F.col("root") == root)
    rows = _rows(_authored(both, persons.where(~F.col("isdeleted"))), "root").distinct()
    return _in_order(rows, root is not None, "messagetime", "root", "message")


def thread_last_n(messages: DataFrame, persons: DataFrame, n: int, root: int | None = None) -> DataFrame:
    """The newest n of the union, oldest first."""
    newest = thread(messages, persons, root).orderBy(F.desc("messagetime"), F.desc("root"), F.desc("message")).limit(n)
    return newest.orderBy("messagetime", "root", "message")


def allowed_sids(members: DataFrame, archive_id: int) -> DataFrame:
    """A null mode of joining is left out, as is mode 20."""
    return members.where((F.col("archiveid") == archive_id) & ~F.col("isdeleted") & (F.col("mode_of_join") != 20)).select("sid").distinct()


def thread_roots(messages: DataFrame, site_id: int, archive_id: int) -> DataFrame:
    return messages.where((F.col("siteid") == site_id) & (F.col("archiveid") == archive_id) & (F.col("commentvia") == 0) & (F.col("role") == 2) & ~F.col("isdeleted")).select("smsgid").distinct()


FEED = ("siteid", "sid", "smsgid", "commentvia", "msgtype", "message", "archiveid", "messagetime", "editedon", "isdeleted", "teamstreamtype")


def index_feed(messages: DataFrame, streams: DataFrame, site_id: int | None = None, sids: list[int] | None = None) -> DataFrame:
    m = messages.where(F.col("msgtype").isin(*INDEXED_TYPES) & ~F.col("isdeleted"))
    m = m if site_id is None else m.where(F.col("siteid") == site_id)
    m = m if sids is None else m.where(F.col("sid").isin(sids))
    return m.join(streams.select(F.col("id").alias("stream"), "teamstreamtype"), F.col("sid") == F.col("stream")).select(*FEED)


def keyset_page(feed: DataFrame, after: tuple[datetime, int], size: int) -> DataFrame:
    """The next rows after (messagetime, smsgid)."""
    at, key = F.lit(after[0]).cast("timestamp_ntz"), after[1]
    return feed.where((F.col("messagetime") > at) | ((F.col("messagetime") == at) & (F.col("smsgid") > key))).orderBy("messagetime", "smsgid").limit(size)


def is_zero_date(t: Column) -> Column:
    return t.isNull() | t.cast("string").startswith("0000-00-00") | t.cast("string").startswith("0001-01-01")


def search_messages(feed: DataFrame) -> DataFrame:
    """Rows of the index feed as search documents."""
    reply = F.col("msgtype") == 20
    linked = reply & (F.col("commentvia") != 0)
    edited = ~is_zero_date(F.col("editedon"))
    return feed.select(
        F.col("siteid").alias("site_id"), "sid", F.col("smsgid").alias("message_id"), F.col("archiveid").alias("author_archive_id"), F.when(linked, F.col("commentvia")).otherwise(F.col("smsgid")).alias("thread_root_id"),
        F.when(linked, F.col("commentvia")).alias("parent_message_id"), channel_type(F.col("teamstreamtype")).alias("channel_type"), F.col("msgtype").cast("string").alias("message_type"),
        F.coalesce("message", F.lit("")).alias("text"), F.col("messagetime").alias("created_at"), F.when(edited, F.col("editedon")).otherwise(F.col("messagetime")).alias("updated_at"),
        reply.alias("is_thread_reply"), edited.alias("is_edited"), F.col("isdeleted").alias("is_deleted"),
    )
