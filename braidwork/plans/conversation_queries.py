"""Queries of conversation processing and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import patterns as P
from braidwork.functions import text as x
from braidwork.functions import times
from braidwork.operators import conversation as c
from braidwork.sources import changes
from braidwork.sources import tables as t

from .registry import Registry

Q = Registry()
#: Openings put before the turns' texts, so that the predicates have something to find.
LEADS = ("I will search for ", "please send a message to Dana saying ", "rephrase ", "what is ", "tell my team that ", "", "processing the request with a lookup tool", "the meaning of ")


def _asked(s: SparkSession, d: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(v) for v in LEADS]), (F.col("turn") % 8 + 1).cast("int"))
    return t.table(s, d, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("q"))


# The oracle's classes and word ends know ASCII only, so ``f`` is the text in which they mean what they do in the patterns: letters that
# fold to ASCII are folded, other word characters of all scripts are "_", which no pattern names, and blanks of all kinds are spaces.
_BEYOND = r"[^\x00-\x7F\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\p{S}\p{Z}\p{Cc}\p{Cf}\p{Co}\p{No}]|[\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"
_FOLDED = rf"regexp_replace(regexp_replace(translate(coalesce(q, ''), 'ſKıİ', 'skii'), '[\x0B\x{{85}}\p{{Z}}]', ' ', 'g'), '{_BEYOND}', '_', 'g')"
_ASKED = f"asked AS (SELECT *, {_FOLDED} AS f FROM (SELECT conv_id, turn, l || text AS q FROM (SELECT *, list_extract([" + ", ".join(f"'{v}'" for v in LEADS) + "], CAST(turn % 8 + 1 AS INTEGER)) AS l FROM conversations)))"


def _rx(patterns: tuple[str, ...], on: str = "f") -> str:
    return "(" + " OR ".join(f"regexp_matches({on}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


_UP = _rx(P.UPGRADE)
Q.add(
    "meta_response", lambda s, d: _asked(s, d).select("conv_id", "turn", x.is_meta_response(F.col("q")).alias("meta")),
    f"""WITH {_ASKED} SELECT conv_id, turn, trim(q) = '' OR {_rx(P.META_RESPONSE, 'trim(f)')} OR (len(string_split_regex(trim(q), '\\s+')) <= 15 AND regexp_matches(lower(q), 'search|lookup') AND regexp_matches(lower(q), 'process|tool|request')) AS meta FROM asked""",
)
Q.add("inquiry", lambda s, d: _asked(s, d).select("conv_id", "turn", x.is_inquiry(F.col("q")).alias("inquiry")), f"WITH {_ASKED} SELECT conv_id, turn, NOT {_UP} AND (regexp_matches(f, '\\?\\s*$') OR {_rx(P.QUESTION_START)} OR {_rx(P.INQUIRY)}) AS inquiry FROM asked")
Q.add("send_action", lambda s, d: _asked(s, d).select("conv_id", "turn", x.is_send_action(F.col("q")).alias("send")), f"WITH {_ASKED} SELECT conv_id, turn, NOT {_UP} AND {_rx(P.SEND_ACTION)} AS send FROM asked")
Q.add(
    "send_recipient", lambda s, d: _asked(s, d).where(x.is_send_action(F.col("q"))).select("conv_id", "turn", x.send_recipient(F.col("q")).alias("recipient")),
    f"""WITH {_ASKED}, r AS (SELECT conv_id, turn, trim(regexp_extract(q, '(?i){P.RECIPIENT.replace(chr(39), chr(39) * 2)}', 1)) AS r FROM asked WHERE NOT {_UP} AND {_rx(P.SEND_ACTION)})
      SELECT conv_id, turn, CASE WHEN r = '' THEN NULL WHEN lower(r) LIKE 'my %' THEN 'your ' || substr(r, 4) ELSE r END AS recipient FROM r""",
)
Q.add(
    "personalize", lambda s, d: _asked(s, d).select("conv_id", "turn", x.personalized(F.col("q"), "Dana").alias("q")),
    f"WITH {_ASKED} SELECT conv_id, turn, regexp_replace(q, '(?i)\\bDana\\b', 'you', 'g') AS q FROM asked",
)

#: The entities that the pages contain.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_UNESCAPED = "html"
for _e, _c in ENTITIES:
    _UNESCAPED = f"replace({_UNESCAPED}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
_CLEANED = f"trim(regexp_replace(regexp_replace({_UNESCAPED}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"
Q.add(
    "mojibake_repair",
    lambda s, d: t.table(s, d, "documents").select("doc_id", "text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("broken")).select("doc_id", x.repaired(F.col("broken")).alias("mended"), x.repaired(F.col("text")).alias("kept")),
    "SELECT doc_id, text AS mended, text AS kept FROM documents",
)
Q.add("clean_text", lambda s, d: t.table(s, d, "pages").select("page_id", x.clean_message(F.col("html")).alias("cleaned")), f"SELECT page_id, {_CLEANED} AS cleaned FROM pages")


def _chatty(s: SparkSession, d: str) -> DataFrame:
    """Turns, some of them in markup, and after some of them one that says little."""
    k, turns = F.col("turn") % 6, t.table(s, d, "conversations")
    text = F.when(k == 5, F.concat(F.lit("<b>"), "text", F.lit("</b> &amp; more"))).otherwise(F.col("text"))
    more = turns.where(k.isin(1, 3)).select("conv_id", (F.col("turn") + 1_000_000).alias("turn"), F.when(k == 1, "ok").otherwise("123 !!").alias("message"))
    return turns.select("conv_id", "turn", text.alias("message")).union(more)


Q.add(
    "noise_filter", lambda s, d: c.without_noise(_chatty(s, d)),
    r"""WITH m AS (SELECT conv_id, turn, CASE turn % 6 WHEN 5 THEN '<b>' || text || '</b> &amp; more' ELSE text END AS message FROM conversations
        UNION ALL SELECT conv_id, turn + 1000000, CASE turn % 6 WHEN 1 THEN 'ok' ELSE '123 !!' END FROM conversations WHERE turn % 6 IN (1, 3)),
      k AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(message, '&amp;', '&'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS message FROM m)
      SELECT * FROM k WHERE message <> '' AND regexp_matches(message, '[a-zA-ZÀ-ɏ]') AND len(string_split(message, ' ')) >= 2""",
)
Q.add(
    "display_name", lambda s, d: t.messages(s, d).join(t.persons(s, d), F.col("archiveid") == F.col("im_archiveid"), "left").select("smsgid", x.display_name(F.col("firstname"), F.col("lastname"), F.col("username")).alias("name")),
    t.with_views("SELECT smsgid, CASE archiveid WHEN 1 THEN 'Dana Fox' WHEN 2 THEN 'robin' ELSE 'User' END AS name FROM messages", "messages"),
)


def _json_messages(s: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 4
    raw = F.when(k == 0, F.to_json(F.struct(F.lit(" ").alias("text"), F.col("text").alias("msg")))).when(k == 1, F.to_json(F.struct(F.col("text").alias("message")))).when(k == 2, F.concat(F.lit("{"), F.col("text"))).otherwise(F.col("text"))
    return t.table(s, d, "conversations").select("conv_id", "turn", x.message_text(raw).alias("message"))


Q.add("json_message_text", _json_messages, "SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN '{' || text ELSE text END AS message FROM conversations")


def _files(s: SparkSession, d: str) -> DataFrame:
    """Messages in the forms that carry attachments."""
    k, name = F.col("turn") % 5, F.concat("role", F.lit("/"), F.col("turn").cast("string"))
    one = F.struct(name.alias("link"), F.col("text").alias("note"))
    by_id = F.struct(F.lit("").alias("link"), F.col("conv_id").alias("fileid"))
    raw = F.when(k == 0, F.to_json(F.array(one, one))).when(k == 1, F.to_json(F.struct(F.array(one).alias("msg")))).when(k == 2, F.to_json(F.struct(by_id.alias("msg")))).when(k == 3, F.to_json(one)).otherwise(F.col("text"))
    return t.table(s, d, "conversations").select("conv_id", "turn", F.posexplode(x.attachments(raw)).alias("place", "a")).select("conv_id", "turn", "place", "a.link")


Q.add(
    "attachment_links", _files,
    """SELECT conv_id, turn, p AS place, CASE WHEN turn % 5 = 2 THEN CAST(conv_id AS VARCHAR) ELSE role || '/' || CAST(turn AS VARCHAR) END AS link
      FROM conversations, (VALUES (0), (1)) v(p) WHERE turn % 5 < 4 AND (p = 0 OR turn % 5 = 0)""",
)
Q.add("document_ids", lambda s, d: t.table(s, d, "documents").select("doc_id", x.document_id(F.sha2("text", 256), F.col("doc_id")).alias("id")), "SELECT doc_id, 'document:' || coalesce(sha256(text), CAST(doc_id AS VARCHAR)) AS id FROM documents")
Q.add(
    "tz_convert", lambda s, d: t.table(s, d, "events").select("event_id", times.from_utc(F.col("ts"), "Asia/Calcutta").alias("local_time"), times.to_utc(F.col("ts"), "America/New_York").alias("utc")),
    "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS local_time, ts + INTERVAL 5 HOUR AS utc FROM events",
)
Q.add(
    "timestamp_parse", lambda s, d: t.table(s, d, "events").select("event_id", times.parsed(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy/MM/dd"))).alias("at")),
    "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(date_trunc('second', ts) AS TIMESTAMP) END AS at FROM events",
)
Q.add(
    "duration_label", lambda s, d: t.table(s, d, "events").groupBy("user_id").agg(times.seconds_between(F.min("ts"), F.max("ts")).alias("seconds")).select("user_id", times.duration_label(F.col("seconds") % 200000).alias("label")),
    """WITH s AS (SELECT user_id, date_sub('second', min(ts), max(ts)) % 200000 AS s FROM events GROUP BY 1)
      SELECT user_id, CASE WHEN s >= 86400 THEN CAST(s // 86400 AS VARCHAR) || 'd ' ELSE '' END || printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS label FROM s""",
)

_BEFORE = "SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events"
Q.add(
    "boundary_strength", lambda s, d: c.boundary_strength(t.table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "strength"),
    f"""SELECT event_id, CASE WHEN b IS NULL THEN 0 WHEN year(ts) * 12 + month(ts) <> year(b) * 12 + month(b) THEN 4 WHEN isoyear(ts) * 100 + weekofyear(ts) <> isoyear(b) * 100 + weekofyear(b) THEN 3
      WHEN CAST(ts AS DATE) <> CAST(b AS DATE) THEN 2 WHEN date_sub('second', b, ts) >= 1800 THEN 1 ELSE 0 END AS strength FROM ({_BEFORE})""",
)
Q.add(
    "cumulative_tokens", lambda s, d: c.cumulative_tokens(t.table(s, d, "conversations").select("conv_id", "turn", "text"), "conv_id", x.token_estimate(F.col("text")), "turn").select("conv_id", "turn", "tokens", "cumulative"),
    "SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(sum(ceil(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS cumulative FROM conversations",
)
Q.add(
    "batch_split",
    lambda s, d: c.time_aligned_batches(c.counted(t.messages(s, d)).select("sid", "messagetime", "tokens", "smsgid"), "sid", "messagetime", "tokens", 400, "smsgid").select("sid", "smsgid", "batch"),
)
Q.add(
    "binpack", lambda s, d: c.adjacent_groups(c.counted(t.messages(s, d)).select("sid", "smsgid", "tokens"), "sid", "smsgid", "tokens", 300).select("sid", "smsgid", "pack"),
    t.with_views(""", m AS (SELECT sid, smsgid, CAST(greatest(ceil(length(message) / 4), 1) AS BIGINT) AS k, row_number() OVER (PARTITION BY sid ORDER BY smsgid) AS n FROM messages),
      f AS (SELECT sid, smsgid, n, k AS total, 0 AS pack FROM m WHERE n = 1 UNION ALL
        SELECT m.sid, m.smsgid, m.n, CASE WHEN f.total + m.k > 300 THEN m.k ELSE f.total + m.k END, CASE WHEN f.total + m.k > 300 THEN f.pack + 1 ELSE f.pack END FROM f JOIN m ON m.sid = f.sid AND m.n = f.n + 1)
      SELECT sid, smsgid, pack FROM f""", "messages").replace("WITH ", "WITH RECURSIVE ", 1),
)

_sums = lambda s, d: t.stored_summaries(s, d)
Q.add("summary_dedup", lambda s, d: c.latest_by_interval(_sums(s, d).withColumn("end_date", F.col("start_date") + F.expr("INTERVAL '1' DAY")).withColumn("ref_id", F.col("ref_id") % 10)).select("ref_id", "id", "start_date"),
      t.with_views("SELECT ref_id % 10 AS ref_id, max(id) AS id, start_date FROM stored_summaries GROUP BY ref_id % 10, start_date", "stored_summaries"))
Q.add(
    "summary_subsume", lambda s, d: c.not_contained(_sums(s, d)).select("ref_id", "id", "start_date", "end_date"),
    t.with_views("""SELECT ref_id, id, start_date, end_date FROM stored_summaries a WHERE NOT EXISTS (SELECT 1 FROM stored_summaries b WHERE b.ref_id = a.ref_id
      AND b.start_date <= a.start_date AND b.end_date >= a.end_date AND b.end_date - b.start_date > a.end_date - a.start_date)""", "stored_summaries"),
)
Q.add(
    "summary_lookup", lambda s, d: _sums(s, d).where("ref_id = 7 and start_date >= timestamp_ntz'2024-01-05' and end_date <= timestamp_ntz'2024-01-20'").select("id", "start_date", "end_date"),
    t.with_views("SELECT id, start_date, end_date FROM stored_summaries WHERE ref_id = 7 AND start_date >= TIMESTAMP '2024-01-05' AND end_date <= TIMESTAMP '2024-01-20'", "stored_summaries"),
)
Q.add(
    "coverage_gaps", lambda s, d: c.coverage_gaps(_sums(s, d), F.expr("timestamp_ntz'2024-01-05 12:00:00'"), F.expr("timestamp_ntz'2024-01-20'")),
    t.with_views(""", k AS (SELECT ref_id, greatest(start_date, TIMESTAMP '2024-01-05 12:00:00') AS s, least(end_date, TIMESTAMP '2024-01-20') AS e FROM stored_summaries),
      o AS (SELECT *, max(e) OVER (PARTITION BY ref_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM k WHERE s <= e),
      g AS (SELECT ref_id, coalesce(r + INTERVAL 1 SECOND, TIMESTAMP '2024-01-05 12:00:00') AS gap_start, s - INTERVAL 1 SECOND AS gap_end FROM o WHERE r IS NULL OR s > r
        UNION ALL SELECT ref_id, max(e) + INTERVAL 1 SECOND, TIMESTAMP '2024-01-20' FROM o GROUP BY ref_id) SELECT * FROM g WHERE gap_start <= gap_end""", "stored_summaries"),
)


_window = lambda: (F.expr("timestamp_ntz'2024-01-05 12:00:00'"), F.expr("timestamp_ntz'2024-01-20'"))
_EXTENDED = Q.oracle["coverage_gaps"].replace("FROM stored_summaries),", "FROM busy),").replace(", k AS (", ", busy AS (SELECT * FROM stored_summaries WHERE n > 2), k AS (").replace(" SELECT * FROM g WHERE gap_start <= gap_end", """,
      d AS (SELECT e.event_id, e.user_id FROM events e JOIN g ON g.ref_id = e.user_id AND e.ts BETWEEN gap_start AND gap_end WHERE gap_start <= gap_end)""")
_busy = lambda s, d: _sums(s, d).where("n > 2")
_stamped = lambda s, d: t.table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
Q.add(
    "summary_delta", lambda s, d: c.uncovered(_stamped(s, d), c.coverage_gaps(_busy(s, d), *_window()), "user_id", "ts").select("event_id", "user_id"),
    f"{_EXTENDED} SELECT event_id, user_id FROM d",
)
Q.add(
    "summary_extend", lambda s, d: c.extended(_busy(s, d), _stamped(s, d), *_window(), "user_id", "ts"),
    f"""{_EXTENDED}, i AS (SELECT * FROM busy WHERE start_date <= TIMESTAMP '2024-01-20' AND end_date >= TIMESTAMP '2024-01-05 12:00:00'),
      l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY end_date DESC, id DESC) = 1), a AS (SELECT user_id, count(*) AS added FROM d GROUP BY 1)
      SELECT ref_id, id, start_date, CASE WHEN added > 0 THEN greatest(end_date, TIMESTAMP '2024-01-20') ELSE end_date END AS end_date, n + coalesce(added, 0) AS n, coalesce(added, 0) AS added FROM l LEFT JOIN a ON user_id = ref_id""",
)


def _cached(s: SparkSession, d: str) -> DataFrame:
    """The cache after its extended rows are written over the stored ones, by ref and start."""
    stored = _busy(s, d).drop("id")
    moved = c.extended(_busy(s, d), _stamped(s, d), *_window(), "user_id", "ts").where("added > 0").drop("id", "added")
    return changes.current(changes.together(changes.upserts(stored, 1), changes.upserts(moved, 2)), "ref_id", "start_date", last="end_date").select("ref_id", "start_date", "end_date", "n")


Q.add(
    "summary_cache_upsert", _cached,
    f"""{_EXTENDED}, i AS (SELECT * FROM busy WHERE start_date <= TIMESTAMP '2024-01-20' AND end_date >= TIMESTAMP '2024-01-05 12:00:00'),
      l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY end_date DESC, id DESC) = 1), a AS (SELECT user_id, count(*) AS added FROM d GROUP BY 1),
      x AS (SELECT ref_id, start_date, greatest(end_date, TIMESTAMP '2024-01-20') AS e, n + added AS m FROM l JOIN a ON user_id = ref_id)
      SELECT s.ref_id, s.start_date, coalesce(e, end_date) AS end_date, coalesce(m, n) AS n FROM busy s LEFT JOIN x ON x.ref_id = s.ref_id AND x.start_date = s.start_date""",
)


def _requests(s: SparkSession, d: str) -> DataFrame:
    """The orders of a customer as a request. Prices are summed in whole cents: a sum of doubles depends on the order of its rows, and then on either side of a whole number."""
    r = t.table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp_ntz").alias("a"), F.max("o_orderdate").cast("timestamp_ntz").alias("b"), F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div 100").alias("n"))
    return r.select("o_custkey", c.request_error(F.col("a"), F.col("b"), F.col("n") % 20_000).alias("error"), c.storable(F.nullif(F.col("n") % 3, F.lit(1)), F.col("n") % 2 > 0).alias("storable"))


Q.add(
    "request_guards", _requests,
    """SELECT o_custkey, CASE WHEN date_sub('second', CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP)) > 93 * 86400 THEN 'more than 93 days' WHEN n % 20000 > 10000 THEN 'more than 10000 messages' END AS error, coalesce(n % 3 IN (0, 1), true) AND coalesce(n % 2 <= 0, true) AS storable
      FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 100 AS BIGINT) AS n FROM orders GROUP BY 1)""",
)


def _segments(s: SparkSession, d: str) -> DataFrame:
    stored = _sums(s, d).where("id % 2 = 0").select("ref_id", F.col("start_date").alias("start"), "n")
    chats = _sums(s, d).where("id % 2 = 1").select("ref_id", F.col("start_date").alias("start"), "n")
    return c.segments(stored, chats)


Q.add("segment_order", _segments, t.with_views("SELECT ref_id, start_date AS start, n, CASE WHEN id % 2 = 0 THEN 'summary' ELSE 'chats' END AS type FROM stored_summaries", "stored_summaries"))
Q.add("segment_chats", lambda s, d: c.has_chats(c.payload(_segments(s, d))), t.with_views("SELECT ref_id, bool_or(id % 2 = 1 AND n > 0) AS has_chats FROM stored_summaries GROUP BY 1", "stored_summaries"))
Q.add(
    "segment_metadata", lambda s, d: c.segment_metadata(t.messages(s, d), "sid", "archiveid", "messagetime", "smsgid"),
    t.with_views("""SELECT sid, CAST(sum(n) AS BIGINT) AS n_messages, string_agg(CAST(archiveid AS VARCHAR), ', ' ORDER BY f) AS participants, date_sub('second', min(a), max(b)) AS seconds
      FROM (SELECT sid, archiveid, count(*) AS n, min(smsgid) AS f, min(messagetime) AS a, max(messagetime) AS b FROM messages GROUP BY ALL) GROUP BY sid""", "messages"),
)


def _limits(s: SparkSession, d: str) -> DataFrame:
    single, batch = c.token_limits(1000 + F.col("p_size") * 4000, 0.05, 800, F.col("p_size") * 100, 150_000, 100_000)
    return t.table(s, d, "part").select("p_partkey", single.cast("long").alias("single"), batch.cast("long").alias("batch"))


Q.add(
    "token_limits", _limits,
    """SELECT p_partkey, CAST(greatest(1, least(u, 150000)) AS BIGINT) AS single, CAST(greatest(1, least(100000, greatest(1, least(u, 150000)))) AS BIGINT) AS batch
      FROM (SELECT p_partkey, floor((1000 + p_size * 4000) * CAST(0.95 AS DOUBLE)) - 800 - p_size * 100 AS u FROM part)""",
)


def _summaries(s: SparkSession, d: str) -> DataFrame:
    """Map-reduce with a stand-in for the model: the first words of a text."""
    rows = c.counted(t.messages(s, d))
    split = c.time_aligned_batches(rows.select("sid", "messagetime", "tokens", "smsgid"), "sid", "messagetime", "tokens", 400, "smsgid").select("smsgid", "batch")
    texts = rows.join(split, "smsgid").groupBy("sid", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("smsgid", "message"))), lambda m: m["message"]), "\n").alias("text"))
    return c.map_reduce(texts, "sid", "text", lambda v: " ".join(v.split()[:12]), 60)


Q.add("map_reduce_summary", _summaries)
Q.add("session_gap_30m", lambda s, d: t.table(s, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"),
      """WITH b AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM b) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM g GROUP BY user_id, g.g""")  # fmt: skip
