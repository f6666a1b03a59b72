"""The reference's operators on small inline rows."""

from __future__ import annotations

import io
import json
import random
import time
import zipfile
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.functions import text as x
from braidwork.functions import times
from braidwork.operators import chat, conversation, extraction, metering, search
from braidwork.sources import changes
from braidwork.sources.changes import index_of
from braidwork.streaming import indexing

T0 = datetime(2024, 1, 31, 10)
MESSAGE = "siteid long, sid long, id long, smsgid long, commentvia long, sharemsgid long, msgtype int, message string, archiveid long, role int, messagetime timestamp_ntz, isdeleted boolean, editedon timestamp_ntz"


def message(k, sid=1, comment=0, share=0, kind=0, text="hi there", who=1, minutes=0, deleted=False, edited=None, role=2):
    return (1, sid, k, k, comment, share, kind, text, who, role, T0 + timedelta(minutes=minutes), deleted, edited)


@pytest.fixture(scope="module")
def chats(spark):
    rows = [
        message(1), message(2, comment=1, kind=20, text="same", minutes=5), message(3, comment=1, kind=20, text="same", minutes=5), message(4, comment=0, share=1, kind=20, minutes=6, edited=T0), message(5, comment=1, share=1, kind=20, minutes=7, text="both"),
        message(6, kind=60), message(7, kind=116), message(8, kind=200), message(9, kind=300), message(10, kind=301, minutes=9), message(11, deleted=True), message(12, who=3, minutes=1), message(13, sid=2), message(14, kind=51), message(15, text=None, minutes=2),
    ]
    m = spark.createDataFrame(rows, MESSAGE)
    s = spark.createDataFrame([(1, 2, False), (2, 6, True)], "id long, teamstreamtype int, isdeleted boolean")
    p = spark.createDataFrame([(1, "acme[V]a_dana", 1, "Dana", "", False)], "im_archiveid long, username string, siteid int, firstname string, lastname string, isdeleted boolean")
    return m, s, p


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_chat_reads(spark, chats):
    m, s, p = chats
    assert ids(chat.by_duration(m, s, p, T0, T0 + timedelta(minutes=9))) == [1, 2, 3, 4, 5, 10, 15]
    assert ids(chat.by_duration(m, s, p, T0 + timedelta(minutes=5), T0 + timedelta(minutes=7))) == [2, 3, 4, 5]
    assert [r["id"] for r in chat.last_n(m, s, p, 2).collect()] == [10, 15]
    assert ids(chat.parents(m, s, p), "smsgid") == [1, 2, 3, 4, 5, 6, 7, 10, 12, 15]
    assert [r["message"] for r in chat.thread(m, p, 1).collect()] == ["same", "hi there", "both"]
    assert [r["message"] for r in chat.thread_last_n(m, p, 1, 1).collect()] == ["both"]
    members = spark.createDataFrame([(1, 9, False, 1, 3), (2, 9, False, 20, 0), (3, 9, False, None, 0)], "sid long, archiveid long, isdeleted boolean, mode_of_join int, lastreadsmsgid long")
    assert ids(chat.unread(m, s, members, p, 9)) == [4, 10, 15]
    assert ids(chat.allowed_sids(members, 9), "sid") == [1]
    assert ids(chat.thread_roots(m, 1, 3), "smsgid") == [12]


def test_message_mapping(chats):
    m, s, _ = chats
    got = {r["message_id"]: r for r in chat.search_messages(chat.index_feed(m, s)).collect()}
    assert got[2]["thread_root_id"] == 1 and got[2]["parent_message_id"] == 1 and got[2]["is_thread_reply"]
    assert got[4]["thread_root_id"] == 4 and got[4]["parent_message_id"] is None and got[4]["is_edited"] and got[4]["updated_at"] == T0
    assert got[1]["channel_type"] == "private_channel" and got[13]["channel_type"] is None and got[15]["text"] == "" and 11 not in got
    page = chat.keyset_page(chat.index_feed(m, s), (T0, 1), 3)
    assert [r["smsgid"] for r in page.collect()] == [13, 12, 15]


def test_search_tiers_and_paging(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "brown quick fox"), (3, "quick brownie"), (4, "quikc brown"), (5, "nothing here"), (6, "the quick brown fox")], "message_id long, text string")
    n, avgdl = search.corpus_size(docs)
    post = search.postings(docs)
    assert ids(search.phrase(post, ["quick", "brown"], n, avgdl), "doc") == [1, 6]
    assert ids(search.phrase_prefix(post, ["quick", "brow"], n, avgdl), "doc") == [1, 3, 6]
    assert ids(search.any_term(post, ["quick", "brown"], n, avgdl), "doc") == [1, 2, 3, 4, 6]
    assert {r["term"] for r in search.fuzzy_terms(post, ["quick"]).collect()} == {"quick"}
    assert {r["term"] for r in search.fuzzy_terms(post, ["browne"]).collect()} == {"brown", "brownie"}
    scored = search.tiered(post, "quick brown", n, avgdl)
    best = search.top_k(scored, 10).collect()
    assert [r["doc"] for r in best][:2] == [1, 6] and [r["rank"] for r in best] == [1, 2, 3, 4, 5]
    first = best[1]
    rest = search.keyset_after(scored, [("score", "desc"), ("doc", "asc")], (first["score"], first["doc"]))
    assert ids(rest, "doc") == [2, 3, 4]


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["doc"], r["score"], r["distance"]) for r in search.knn(v, [3.0, 0.0], 5).collect()]
    assert got == [(1, 1.0, 0.0), (5, 1.0, 0.0), (2, 0.0, 1.0), (3, -1.0, 2.0)]
    a, b = (spark.createDataFrame(z, "doc long, score double") for z in ([(1, 9.0), (2, 5.0), (3, 1.0)], [(2, 0.5), (4, 0.5)]))
    assert {r["doc"]: r["score"] for r in search.fuse_minmax(a, b).collect()} == {1: 0.5, 2: 0.75, 3: 0.0, 4: 0.5}
    assert {r["doc"]: r["score"] for r in search.fuse_rrf(a, b).collect()}[2] == round(1 / 62 + 1 / 61, 6)


def test_access_and_filters(spark):
    docs = spark.createDataFrame([(i, 1, i, i, "dm", i == 4, T0 + timedelta(hours=i), i) for i in range(6)], "message_id long, site_id long, sid long, thread_root_id long, channel_type string, is_deleted boolean, created_at timestamp_ntz, author_archive_id long")
    one = lambda *v: spark.createDataFrame([(i,) for i in v], "k long")
    assert ids(search.authorised(docs, one(1, 2), one(2, 5)), "message_id") == [1, 2, 5]
    assert search.authorised(docs, one(), one()).count() == 0
    at = T0.timestamp() if T0.tzinfo else (T0 - datetime(1970, 1, 1)).total_seconds()
    spec = search.SearchSpec(query=" a  ﬁ ", site_id=1, after=at + 3600, before=at + 3 * 3600)
    assert spec.query == "a fi" and ids(docs.where(search.predicates(spec)), "message_id") == [1, 2]
    with pytest.raises(ValueError):
        search.SearchSpec(query=" ", site_id=1)
    with pytest.raises(ValueError):
        search.SearchSpec(query="a", site_id=1, limit=101)


def test_responses_page_to_the_end(spark):
    """Three pages of one content type, one of another, and none of a third; pages in order are the whole result."""
    fields = "message_id long, site_id long, sid long, thread_root_id long, channel_type string, is_deleted boolean, created_at timestamp_ntz, author_archive_id long, text string"
    rows = [(i, 1, 1 + i // 10, i, "dm", False, T0 + timedelta(hours=i % 3), i, "blue " + "moon " * (i % 3) + "x" * i) for i in range(12)]
    docs = spark.createDataFrame(rows, fields)
    one = lambda *v: spark.createDataFrame([(i,) for i in v], "k long")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(12)], "message_id long, embedding array<double>")
    sources = {"messages": docs, "files": docs.where("message_id < 2")}
    kinds = ("messages", "files", "mail")
    for how in ({}, {"sort": "created_at"}, {"methods": ("lexical", "semantic")}):
        spec = search.SearchSpec(query="blue moon", site_id=1, limit=4, content_types=kinds, **how)
        more = {"sids": one(1), "roots": one(11), "vectors": vectors, "query_vector": [1.0, 0.0]}
        wide = search.search(docs, search.SearchSpec(query="blue moon", site_id=1, limit=100, **how), **more).orderBy("rank").collect()
        got, cursor, pages = [], None, 0
        while pages == 0 or cursor:
            r = search.respond(sources, spec, cursor, **more)
            assert r.results["mail"].status == ("error" if pages == 0 else "success") and len(r.results["files"].candidates) == (2 if pages == 0 else 0)
            assert r.results["messages"].total == 11 and (r.results["files"].total == 2) == (pages == 0)
            got += [row["message_id"] for row in r.results["messages"].candidates]
            cursor, pages = r.next_cursor, pages + 1
        assert pages == 3 and len(got) == len(set(got)) == 11
        if "methods" not in how:  # the depth of a hybrid leg depends on the limit
            assert got == [row["message_id"] for row in wide]
    with pytest.raises(ValueError):
        search.respond(sources, search.SearchSpec(query="red", site_id=1), search.encode_cursor(search.Cursor("", "score", "desc", 1, {})), sids=one(1), roots=one(1))


def test_cursor():
    spec = search.SearchSpec(query="a", site_id=1)
    text = search.next_cursor(spec, (1.5, 7))
    c = search.decode_cursor(text)
    search.check_cursor(c, spec)
    assert c.search_after == {"messages": [1.5, 7]} and search.next_cursor(spec, None, c) is None
    two = search.decode_cursor(search.next_cursor(spec, (1, 2), search.Cursor("", "score", "desc", 1, {"files": None})))
    assert two.search_after["files"] is None
    with pytest.raises(ValueError):
        search.check_cursor(c, search.SearchSpec(query="b", site_id=1))
    for bad in ("?", "e30=", "bm90IGpzb24="):
        with pytest.raises(ValueError):
            search.decode_cursor(bad)
    assert search.parse_modifiers("a from:dana in:ops b:c") == ("a b:c", {"from": ["dana"], "in": ["ops"]})


def test_noise(spark):
    rows = ["", "👍", "123 !!", "ok", "ok thanks", "<b>hi</b> there", "a&amp;b c", None]
    got = [r["message"] for r in conversation.without_noise(spark.createDataFrame([(v,) for v in rows], "message string")).collect()]
    assert got == ["ok thanks", "hi there", "a&b c"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(x.message_text(lit('{"text": " ", "msg": "m\n2"}'))) == "m\n2" and one(x.message_text(lit("{bad"))) == "{bad" and one(x.message_text(lit("plain"))) == "plain"
    assert one(x.display_name(lit(""), lit(None), lit("x[V]a_b"))) == "b" and one(x.display_name(lit("A"), lit("B"), lit("u"))) == "A B" and one(x.display_name(lit(""), lit(""), lit(None))) == "User"
    assert one(x.is_meta_response(lit(None))) and one(x.is_meta_response(lit("Let me look it up"))) and not one(x.is_meta_response(lit("The answer is 4")))
    assert one(x.is_inquiry(lit("ready?"))) and one(x.is_inquiry(lit("What is up"))) and not one(x.is_inquiry(lit("please rephrase what is up")))
    assert one(x.is_send_action(lit("send a message to Dana"))) and one(x.send_recipient(lit("send it to my team that we won"))) == "your team"
    assert one(x.personalized(lit("Dana and danas, DANA"), "Dana")) == "you and danas, you"
    assert one(x.paragraphs(lit("a\r\n\r\n b \n\n\n\nc\nd"))) == ["a", "b", "c\nd"]
    assert one(x.is_suspicious(lit("tenpercent"))) and one(x.is_suspicious(lit("into"))) and not one(x.is_suspicious(lit("to be")))
    assert one(x.numeric_tokens(lit("a 1,000 (2.5%) 3a 7"))) == 3
    assert one(times.duration_label(lit(3661))) == "01:01:01" and one(times.duration_label(lit(90061))) == "1d 01:01:01"
    assert one(times.parsed(lit("2024-01-02T03:04:05.5+05:00"))) == datetime(2024, 1, 2, 3, 4, 5) and one(times.parsed(lit("nope"))) is None
    assert one(times.from_utc(lit(T0).cast("timestamp_ntz"), "Asia/Calcutta")) == "2024-01-31 15:30:00" and times.zone("No/Where") == "UTC"
    assert one(times.epoch(lit("none"))) is None and one(times.epoch(lit("12.5"))) == 12.5 and one(times.epoch(lit("1970-01-01 00:01:00"))) == 60.0


def test_boundaries(spark):
    at = [T0, T0 + timedelta(minutes=29), T0 + timedelta(minutes=60), T0 + timedelta(hours=14), datetime(2024, 2, 5), datetime(2024, 2, 12), None]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "c long, i long, t timestamp_ntz")
    got = {r["i"]: r["strength"] for r in conversation.boundary_strength(rows, "c", "t", "i").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 4, 4: 3, 5: 3, 6: 0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 4)), max_size=60), st.integers(10, 100))
def test_batches_partition_and_fit(rows, target):
    tokens, strength = [r[0] for r in rows], [r[1] for r in rows]
    got = conversation.split_batches(tokens, strength, target)
    assert got == sorted(got) and len(got) == len(tokens)
    for b in set(got):
        own = [t for t, g in zip(tokens, got) if g == b]
        assert sum(own) <= target or len(own) == 1
    packs = conversation.pack_adjacent(tokens, target)
    assert all(sum(own) <= target or len(own) == 1 for own in ([t for t, g in zip(tokens, packs) if g == k] for k in set(packs)))


def test_intervals(spark):
    d = lambda n: datetime(2024, 1, n)
    rows = [(1, 7, d(2), d(4)), (2, 7, d(2), d(4)), (3, 7, d(2), d(3)), (4, 7, d(4), d(5)), (5, 7, d(8), d(9)), (6, 7, d(20), d(21)), (7, 8, d(1), d(30))]
    s = spark.createDataFrame(rows, "id long, ref_id long, start_date timestamp_ntz, end_date timestamp_ntz")
    assert ids(conversation.latest_by_interval(s)) == [2, 3, 4, 5, 6, 7]
    assert ids(conversation.not_contained(s)) == [1, 2, 4, 5, 6, 7]
    gaps = conversation.coverage_gaps(s, F.lit(d(1)).cast("timestamp_ntz"), F.lit(d(10)).cast("timestamp_ntz")).where("ref_id = 7").orderBy("gap_start").collect()
    second = timedelta(seconds=1)
    assert [(g["gap_start"], g["gap_end"]) for g in gaps] == [(d(1), d(2) - second), (d(5) + second, d(8) - second), (d(9) + second, d(10))]


def test_map_reduce(spark):
    rows = spark.createDataFrame([(1, 0, "aa bb"), (1, 1, "fail"), (1, 2, "cc dd"), (2, 0, "fail")], "c long, batch int, text string")

    def model(t):
        if "fail" in t:
            raise RuntimeError
        return t.upper()

    got = {r["c"]: (r["summary"], r["unavailable"]) for r in conversation.map_reduce(rows, "c", "text", model, 100).collect()}
    assert got == {1: ("AA BB\nCC DD", 1), 2: (None, 1)}


def plain_map_reduce(texts, model, limit, rounds=4):
    """Of one conversation, as a loop over its texts in order."""
    done = []
    for v in texts:
        try:
            done.append(model(v))
        except RuntimeError:
            pass
    for _ in range(rounds):
        if len(done) <= 1:
            break
        packs = conversation.pack_adjacent([-(-len(v) // 4) for v in done], limit)
        groups = [[v for v, g in zip(done, packs) if g == k] for k in range(packs[-1] + 1)]
        done = [model("\n".join(g)) if len(g) > 1 else g[0] for g in groups]
    return ("\n".join(done) if done else None, len(texts) - sum("fail" not in v for v in texts))


def test_map_reduce_rounds_equal_a_plain_loop(spark):
    rng = random.Random(3)
    talks = {c: ["fail" if rng.random() < 0.2 else " ".join(rng.choice("abcdef") * 3 for _ in range(rng.randint(1, 30))) for _ in range(n)] for c, n in enumerate((1, 2, 7, 40, 3))}

    def model(v):
        if "fail" in v:
            raise RuntimeError
        return v[: max(4, len(v) * 2 // 3)]

    rows = spark.createDataFrame([(c, b, v) for c, vs in talks.items() for b, v in enumerate(vs)], "c long, batch int, text string")
    got = {r["c"]: (r["summary"], r["unavailable"]) for r in conversation.map_reduce(rows, "c", "text", model, 30).collect()}
    assert got == {c: plain_map_reduce(vs, model, 30) for c, vs in talks.items()}


def test_walks_equal_the_plain_versions(spark):
    """Frames of three rows, so that cuts and packs cross them; one conversation has most rows, one has null times."""
    rng = random.Random(5)
    sizes = {1: 150, 2: 1, 3: 12, None: 20, 5: 17}
    rows = [(c, i, T0 + timedelta(minutes=rng.choice((1, 40, 900)) * i) if c != 5 or i % 4 else None, rng.choice((1, 2, 5, 9, 30))) for c, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "c long, i long, t timestamp_ntz, k long").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        batches = conversation.time_aligned_batches(frame, "c", "t", "k", 25, "i").collect()
        packs = conversation.adjacent_groups(frame, "c", "i", "k", 20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(batches) == len(packs) == len(rows)
    for c in sizes:
        own = sorted((r for r in batches if r["c"] == c), key=lambda r: (r["i"] if c == 5 else 0, r["t"] or T0, r["i"]))
        assert [r["batch"] for r in own] == conversation.split_batches([r["k"] for r in own], [r["strength"] for r in own], 25)
        own = sorted((r for r in packs if r["c"] == c), key=lambda r: r["i"])
        assert [r["pack"] for r in own] == conversation.pack_adjacent([r["k"] for r in own], 20)
    empty = frame.where("false")
    assert conversation.time_aligned_batches(empty, "c", "t", "k", 25, "i").count() == conversation.adjacent_groups(empty, "c", "i", "k", 20).count() == 0


def xlsx(sheet, merges=""):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData>{merges}</worksheet>")
    return out.getvalue()


def test_parsers(spark):
    cell = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
    book = xlsx(f"<row>{cell('A1', 'Banner')}</row><row>{cell('A2', 'k')}{cell('B2', 'v')}</row><row>{cell('A3', '007')}</row>", '<mergeCells><mergeCell ref="A1:B1"/></mergeCells>')
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 10_000_000)
    files = [
        ("a", "csv", b"Region,Nodes\nap,007\nx\n"), ("b", "csv", b"a,b\n1,2\n1,2,3,4\n"), ("c", "json", b'{"a": [1, "\xc3\xa9"]}'), ("d", "json", b"[" * 100_000), ("e", "yaml", b"key: [unclosed"), ("f", "yaml", ("\n".join(f"k{i}: &a{i} 1" for i in range(1100))).encode()),
        ("g", "xml", b"<r><a n='1'>t &amp; u</a></r>"), ("h", "xml", b'<!DOCTYPE r [<!ENTITY x "y">]><r>&x;</r>'), ("i", "txt", "é\n\nb".encode("latin-1")), ("j", "txt", b""), ("k", "py", b"print(1)\n"), ("l", "zzz", b"x"), ("m", "xlsx", book), ("n", "xlsx", bomb.getvalue()), ("o", "xlsx", b"no"),
        ("p", "md", b"# T\n\npara one\nmore\n\n## H\n\n- a\n- b\n\n1. c\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```py\ncode\n```\n"), ("q", "html", b"<html><head><title>no</title></head><body><h1>T</h1><p>a &amp; b</p><ul><li>x</li></ul><table><tr><th>h</th></tr><tr><td>v</td></tr></table><script>s</script></body></html>"),
        ("r", "rst", b"Title\n=====\n\nSection\n-------\n\n* a\n* b\n\nCode::\n\n  x = 1\n\n.. include:: /etc/passwd\n"), ("s", "txt", b"x\n\n" * 200_001), ("t", "txt", None),
    ]
    done = extraction.extract(spark.createDataFrame(files, "file_id string, extension string, content binary"))
    got = {r["file_id"]: r for r in done.collect()}
    assert {k for k, r in got.items() if r["status"] == "failed"} == set("bdefhjlnost")
    assert {got[k]["error"] for k in "dfns"} == {"RESOURCE_LIMIT_EXCEEDED"} and {got[k]["error"] for k in "behjot"} == {"INVALID_CONTENT"} and got["l"]["error"] == "UNSUPPORTED_FORMAT"
    assert [(c["row"], c["column"], c["text"], c["header"]) for c in got["a"]["cells"]] == [(0, 0, "Region", True), (0, 1, "Nodes", True), (1, 0, "ap", False), (1, 1, "007", False), (2, 0, "x", False), (2, 1, "", False)]
    assert json.loads(got["c"]["blocks"][0]["text"]) == {"a": [1, "é"]} and "&amp;" in got["g"]["blocks"][0]["text"]
    assert [b["text"] for b in got["i"]["blocks"]] == ["é", "b"] and got["k"]["blocks"][0]["language"] == "python"
    assert [(c["row"], c["column"], c["header"], c["column_span"]) for c in got["m"]["cells"]] == [(0, 0, False, 2), (1, 0, True, 1), (1, 1, True, 1), (2, 0, False, 1), (2, 1, False, 1)]
    kinds = lambda k: [b["type"] for b in got[k]["blocks"]]
    assert kinds("p") == ["title", "paragraph", "heading", "list", "list_item", "list_item", "list", "list_item", "table", "code"] and got["p"]["title"] == "T"
    assert kinds("q") == ["title", "paragraph", "list", "list_item", "table"] and len(got["q"]["cells"]) == 2 and got["q"]["blocks"][1]["text"] == "a & b"
    assert kinds("r") == ["title", "heading", "list", "list_item", "list_item", "paragraph", "code"]
    assert extraction.block_rows(done).where("file_id = 'p'").count() == 10 and extraction.cell_rows(done).where("file_id = 'p'").count() == 4


def test_policy(spark):
    rows = [(0.76, 0.90, 0.55, 0.0, 1.0), (0.50, 0.40, 0.80, 0.0, 1.0), (0.70, 0.90, 0.80, 0.0, 0.50), (0.40, 0.80, 0.10, 0.0, 0.90)]
    q = spark.createDataFrame(rows, "overall_score double, text_score double, structure_score double, table_score double, provenance_score double")
    assert [(r[0], r[1]) for r in q.select(extraction.policy(), extraction.reasons()).collect()] == [("accept", ""), ("fallback", "text,overall"), ("fallback", "provenance"), ("fallback", "overall")]


def test_billing(spark):
    u = spark.createDataFrame([(0, 1_000_000, 0, 0), (3, 1_000_000, 500_000, 1_000_000), (1, 0, 0, 0)], "model_no long, input_tokens long, cached_tokens long, output_tokens long")
    got = {r["model_no"]: r["amount"] for r in metering.billed(u, metering.price_list(spark)).collect()}
    assert got == {0: Decimal("0.15"), 3: Decimal("12.5"), 1: Decimal(0)}  # exact: amounts are decimals


def test_log_stream_and_backfill(spark, chats, tmp_path):
    m, s, _ = chats
    path = str(tmp_path / "log")
    now = lambda: ids(changes.current(changes.read_log(spark, path), "message_id"), "message_id")
    assert changes.read_log(spark, path) is None
    for _ in range(2):  # a repeated job replaces its folder
        assert indexing.backfill(m, s, path, "job") == {"fetched": 8, "indexed": 8} and now() == [1, 2, 3, 4, 5, 12, 13, 15]
    assert indexing.backfill(m, s, str(tmp_path / "part"), "job", (T0, 1))["fetched"] == 7
    t = changes.version_now()
    changes.append(changes.stream_deletes(spark.createDataFrame([(1, 2)], "site_id long, sid long"), t), path, "gone")
    assert now() == [1, 2, 3, 4, 5, 12, 15]
    events = tmp_path / "events"
    spark.createDataFrame([(1, "delete"), (13, "upsert"), (11, "upsert"), (99, "upsert"), (5, "upsert"), (5, "delete")], "message_id long, action string").write.parquet(str(events))
    stream = lambda: indexing.index_stream(spark.readStream.schema("message_id long, action string").parquet(str(events)), path, lambda: (m, s), str(tmp_path / "cp"))
    for _ in range(2):  # a restart finds nothing new
        stream().awaitTermination(120)
        assert now() == [1, 2, 3, 4, 5, 12, 13, 15]  # 1 and 5 are live in the source, whatever their events say
    indexing.reindex_stream(m.where("smsgid <> 2"), s, path, 1, 1)
    assert now() == [1, 3, 4, 5, 12, 13, 15]
    changes.compact(spark, path, str(tmp_path / "new"), "message_id")
    assert ids(changes.current(changes.read_log(spark, str(tmp_path / "new")), "message_id"), "message_id") == now()
    with pytest.raises(ValueError):
        index_of("mail")


@pytest.mark.parametrize("actions", [("upsert", "delete"), ("delete", "upsert"), ("delete",), ("upsert",)])
def test_the_source_row_decides(spark, chats, actions):
    m, s, _ = chats
    e = spark.createDataFrame([(i, a) for i in (1, 11, 99) for a in actions], "message_id long, action string")
    got = indexing.event_changes(e, m, s, 7).collect()
    assert sorted((r["message_id"], r["_action"]) for r in got) == [(1, "upsert"), (11, "delete"), (99, "delete")]


def test_long_texts_take_linear_time(spark):
    n = 200_000
    texts = [" " * n, "\u2003" * n + "x" + "\u3000" * n, "<" * n, "<b>" * n + "end", "a." * n, "\n" * n]
    texts += ["1-" * n, "{" * n, "please send to " * (n // 15), "a " * n]
    t, began = F.col("t"), time.time()
    rest = [x.is_meta_response(t), x.is_inquiry(t), x.is_send_action(t), x.send_recipient(t), x.message_text(t), x.is_suspicious(t), x.numeric_tokens(t), x.prose_normalized(t), F.size(x.paragraphs(t))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", x.collapsed_ends(t).alias("ends"), x.clean_message(t).alias("clean"), *[c.alias(f"c{k}") for k, c in enumerate(rest)]).orderBy("i").collect()
    assert time.time() - began < 60
    assert [got[i]["ends"] for i in (0, 1, 5)] == ["", "x", ""] and [got[i]["clean"] for i in (0, 2, 3)] == ["", "<" * n, "end"]


def test_marks_of_prose(spark):
    texts = {"\n\n  - one\n\n* two\r\n12. three - four": "one two three four", "1.\n\n2.\nx": "x", " \t- a": "a", "a - b.": "a b"}
    got = spark.createDataFrame([(k,) for k in texts], "t string").select("t", x.prose_normalized(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] for r in got} == {k: v for k, v in texts.items()}


def test_embedded(spark):
    docs = spark.createDataFrame([(i, "a" * i if i else None) for i in range(7)], "id long, text string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        assert 0 < len(texts) <= 3
        seen.add(1)
        return [[float(len(v))] for v in texts]

    got = {r["id"]: (r["embedding"], r["embedding_version"]) for r in indexing.embedded(docs, model, "v1", size=3).collect()}
    assert got == {0: (None, None)} | {i: ([float(i)], "v1") for i in range(1, 7)} and seen.value == 3


def test_late_events(spark):
    rows = [(T0, "a", 1, 1.0), (T0 + timedelta(minutes=59), "a", 1, 2.0), (T0 + timedelta(hours=1), "a", 1, 4.0)]
    e = spark.createDataFrame(rows, "ts timestamp, event_type string, user_id long, value double")
    assert sorted((r["n"], r["total"]) for r in indexing.windowed(e).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r["n"] for r in indexing.sessions(e).collect()) == [1, 2] or sorted(r["n"] for r in indexing.sessions(e).collect()) == [1, 1, 1]
