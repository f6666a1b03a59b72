"""Queries of chats, threads, indexing and metering."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import chat, metering
from braidwork.sources import changes
from braidwork.sources import tables as t
from braidwork.streaming import indexing

from .registry import Registry

Q = Registry()
START, END = datetime(2024, 1, 1, 6), datetime(2024, 1, 3)
_RANGE = "BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-03'"
_SHOWN = "(m.msgtype < 200 OR m.msgtype > 300) AND m.msgtype NOT IN (50, 51, 60, 116)"
_COLS = "m.message, m.messagetime, m.archiveid, m.sid, p.username, p.siteid, p.firstname, p.lastname"
_FROM = "FROM messages m JOIN streams s ON s.id = m.sid AND NOT s.isdeleted JOIN persons p ON p.im_archiveid = m.archiveid"
_V = ("messages", "streams", "persons")


def _three(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.messages(s, d), t.streams(s, d), t.persons(s, d)


Q.add("chat_by_duration", lambda s, d: chat.by_duration(*_three(s, d), START, END), t.with_views(f"SELECT {_COLS}, m.id {_FROM} WHERE {_SHOWN} AND NOT m.isdeleted AND m.messagetime {_RANGE}", *_V))
Q.add("chat_last_n", lambda s, d: chat.last_n(*_three(s, d), 10), t.with_views(f"SELECT {_COLS}, m.id {_FROM} WHERE {_SHOWN} AND NOT m.isdeleted ORDER BY m.id DESC LIMIT 10", *_V))
Q.add(
    "chat_unread", lambda s, d: chat.unread(t.messages(s, d), t.streams(s, d), t.members(s, d), t.persons(s, d), 1),
    t.with_views(f"""SELECT {_COLS}, m.id {_FROM} JOIN members i ON i.sid = m.sid AND i.archiveid = 1 AND NOT i.isdeleted
      WHERE {_SHOWN} AND NOT m.isdeleted AND m.archiveid <> 1 AND m.commentvia = 0 AND m.smsgid > i.lastreadsmsgid""", *_V, "members"),
)
Q.add(
    "thread_parent", lambda s, d: chat.parents(*_three(s, d)),
    t.with_views(f"""SELECT {_COLS}, m.smsgid FROM messages m JOIN streams s ON s.id = m.sid AND NOT s.isdeleted LEFT JOIN persons p ON p.im_archiveid = m.archiveid
      WHERE (m.msgtype < 200 OR m.msgtype > 300) AND m.msgtype NOT IN (50, 51) AND NOT m.isdeleted""", *_V),
)
_THREAD = """th AS (SELECT {c}, r.root FROM messages m JOIN persons p ON p.im_archiveid = m.archiveid AND NOT p.isdeleted, LATERAL (SELECT m.sharemsgid AS root UNION SELECT m.commentvia) r
      WHERE m.msgtype IN (20, 23, 24, 25, 26, 27, 28, 81) AND NOT m.isdeleted AND r.root <> 0 {w}), u AS (SELECT DISTINCT * FROM th)"""
Q.add("thread_union", lambda s, d: chat.thread(t.messages(s, d), t.persons(s, d)), t.with_views(", " + _THREAD.format(c=_COLS, w="") + " SELECT * FROM u", *_V))
Q.add("thread_by_duration", lambda s, d: chat.thread(t.messages(s, d), t.persons(s, d), None, START, END), t.with_views(", " + _THREAD.format(c=_COLS, w=f"AND m.messagetime {_RANGE}") + " SELECT * FROM u", *_V))
Q.add("thread_last_n", lambda s, d: chat.thread_last_n(t.messages(s, d), t.persons(s, d), 15), t.with_views(", " + _THREAD.format(c=_COLS, w="") + " SELECT * FROM u ORDER BY messagetime DESC, root DESC, message DESC LIMIT 15", *_V))
Q.add("allowed_sids", lambda s, d: chat.allowed_sids(t.members(s, d), 1), t.with_views("SELECT DISTINCT sid FROM members WHERE archiveid = 1 AND NOT isdeleted AND mode_of_join <> 20", "members"))
Q.add("thread_roots", lambda s, d: chat.thread_roots(t.messages(s, d), 2, 1), t.with_views("SELECT DISTINCT smsgid FROM messages WHERE siteid = 2 AND archiveid = 1 AND commentvia = 0 AND role = 2 AND NOT isdeleted", "messages"))

_FEED = ", feed AS (SELECT m.*, s.teamstreamtype FROM messages m JOIN streams s ON s.id = m.sid WHERE m.msgtype IN (0, 20) AND NOT m.isdeleted)"
_FEED_COLS = "siteid, sid, smsgid, commentvia, msgtype, message, archiveid, messagetime, editedon, isdeleted, teamstreamtype"
_feed = lambda s, d, *a: chat.index_feed(t.messages(s, d), t.streams(s, d), *a)
Q.add("index_feed", lambda s, d: _feed(s, d, 1, [1, 6, 11, 16]).orderBy("messagetime", "smsgid"), t.with_views(f"{_FEED} SELECT {_FEED_COLS} FROM feed WHERE siteid = 1 AND sid IN (1, 6, 11, 16)", "messages", "streams"))
Q.add("point_read", lambda s, d: _feed(s, d).where("siteid = 1 and sid = 6 and smsgid = 6002"), t.with_views(f"{_FEED} SELECT {_FEED_COLS} FROM feed WHERE siteid = 1 AND sid = 6 AND smsgid = 6002", "messages", "streams"))
Q.add(
    "keyset_page", lambda s, d: chat.keyset_page(_feed(s, d), (datetime(2024, 1, 1, 12), 12001), 25),
    t.with_views(f"{_FEED} SELECT {_FEED_COLS} FROM feed WHERE messagetime > TIMESTAMP '2024-01-01 12:00:00' OR (messagetime = TIMESTAMP '2024-01-01 12:00:00' AND smsgid > 12001) ORDER BY messagetime, smsgid LIMIT 25", "messages", "streams"),
)
_MAPPED = """, docs AS (SELECT siteid AS site_id, sid, smsgid AS message_id, archiveid AS author_archive_id, CASE WHEN msgtype = 20 AND commentvia <> 0 THEN commentvia ELSE smsgid END AS thread_root_id,
      CASE WHEN msgtype = 20 AND commentvia <> 0 THEN commentvia END AS parent_message_id,
      CASE teamstreamtype WHEN 0 THEN 'dm' WHEN 1 THEN 'display_channel' WHEN 2 THEN 'private_channel' WHEN 3 THEN 'company_channel' WHEN 4 THEN 'public_channel' WHEN 5 THEN 'temporary_channel' END AS channel_type,
      CAST(msgtype AS VARCHAR) AS message_type, coalesce(message, '') AS text, messagetime AS created_at, coalesce(editedon, messagetime) AS updated_at, msgtype = 20 AS is_thread_reply, editedon IS NOT NULL AS is_edited, isdeleted AS is_deleted FROM feed)"""
Q.add("message_map", lambda s, d: chat.search_messages(_feed(s, d)), t.with_views(f"{_FEED}{_MAPPED} SELECT * FROM docs", "messages", "streams"))


def _changed(s: SparkSession, d: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents of a log with one further write."""
    docs = chat.search_messages(_feed(s, d))
    return changes.current(changes.together(changes.upserts(docs, 1), change(docs)), "message_id")


Q.add(
    "upsert_by_key", lambda s, d: _changed(s, d, lambda docs: changes.upserts(docs.where("is_edited").withColumn("text", F.concat(F.lit("v2 "), "text")), 2)).select("message_id", "text"),
    t.with_views(f"{_FEED}{_MAPPED} SELECT message_id, CASE WHEN is_edited THEN 'v2 ' || text ELSE text END AS text FROM docs", "messages", "streams"),
)
Q.add(
    "delete_by_id", lambda s, d: _changed(s, d, lambda docs: changes.deletes(docs.where("is_thread_reply").select("message_id"), 2)).select("message_id"),
    t.with_views(f"{_FEED}{_MAPPED} SELECT message_id FROM docs WHERE NOT is_thread_reply", "messages", "streams"),
)
Q.add(
    "delete_by_sid", lambda s, d: _changed(s, d, lambda docs: changes.stream_deletes(docs.where("site_id = 1 and channel_type = 'private_channel'"), 2)).select("site_id", "sid", "message_id"),
    t.with_views(f"{_FEED}{_MAPPED} SELECT site_id, sid, message_id FROM docs WHERE NOT (site_id = 1 AND coalesce(channel_type, '') = 'private_channel')", "messages", "streams"),
)
Q.add(
    "embed_batch", lambda s, d: indexing.embedded(chat.search_messages(_feed(s, d)).select("message_id", "text"), _stand_in, "v1").select("message_id", F.col("embedding")[0].alias("length"), F.col("embedding")[1].alias("spaces"), "embedding_version"),
    t.with_views(f"{_FEED}{_MAPPED} SELECT message_id, CAST(length(text) AS DOUBLE) AS length, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces, 'v1' AS embedding_version FROM docs", "messages", "streams"),
)


def _stand_in(texts: list[str]) -> list[list[float]]:
    """In place of a model."""
    return [[float(len(v)), float(v.count(" "))] for v in texts]


_bill = lambda s, d: metering.billed(t.usage(s, d), metering.price_list(s))
_PRICED = """, prices AS (SELECT * FROM (VALUES (0, 1, 'gpt-4o-mini', 0.150, 0.075, 0.600), (1, 5, 'gpt-4.1', 2.00, 0.50, 8.00), (2, 6, 'gpt-4.1-mini', 0.400, 0.100, 1.600), (3, 2, 'gpt-4o', 2.50, NULL, 10.00)) v(model_no, model_id, model_name, p_in, p_cached, p_out)),
      bill AS (SELECT u.*, p.model_id, p.model_name, CAST(CAST(input_tokens - cached_tokens AS DECIMAL(18,0)) * CAST(p_in AS DECIMAL(12,6)) + CAST(cached_tokens AS DECIMAL(18,0)) * CAST(coalesce(p_cached, p_in) AS DECIMAL(12,6)) + CAST(output_tokens AS DECIMAL(18,0)) * CAST(p_out AS DECIMAL(12,6)) AS DECIMAL(28,6)) * CAST(0.000001 AS DECIMAL(7,6)) AS amount
      FROM usage_rows u JOIN prices p USING (model_no))"""
Q.add("billing_amount", lambda s, d: _bill(s, d).select("l_orderkey", "l_linenumber", "model_name", F.round("amount", 6).cast("double").alias("amount")), t.with_views(f"{_PRICED} SELECT l_orderkey, l_linenumber, model_name, CAST(round(amount, 6) AS DOUBLE) AS amount FROM bill", "usage_rows"))
Q.add(
    "billing_rollup", lambda s, d: metering.rollup(_bill(s, d), "siteid", "model_name", "operation"),
    t.with_views(f"{_PRICED} SELECT siteid, model_name, operation, count(*) AS calls, CAST(round(sum(amount), 4) AS DOUBLE) AS amount, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM bill GROUP BY ROLLUP (siteid, model_name, operation)", "usage_rows"),
)
