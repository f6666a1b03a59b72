"""Files, charsets, physical encodings, normalised queries and extraction in passes."""

from __future__ import annotations

import hashlib
import os
import struct
import unicodedata
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.functions import packing, text
from braidwork.operators import extraction
from braidwork.sources import encodings, files

SF = "/root/testdata/sf0.001"


def test_vectors_as_bytes(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 32, 3000, dtype=np.uint64).astype(np.uint32).view(np.float32)
    edges = (2.0 ** np.arange(-149, 128)).astype(np.float32)
    v = np.concatenate([v[~np.isnan(v)], edges, -np.nextafter(edges, np.float32(0)), np.array([0.0, -0.0, np.inf, -np.inf, 3.4028235e38, 0.1], np.float32)])
    df = spark.createDataFrame([(1, [float(x) for x in v]), (2, []), (3, None), (4, [1.0, None]), (5, [float("nan")])], "id int, v array<float>")
    got = {r["id"]: r for r in df.select("id", packing.packed(F.col("v")).alias("b"), packing.unpacked(packing.packed(F.col("v"))).alias("u")).collect()}
    assert bytes(got[1]["b"]) == v.astype("<f4").tobytes()
    assert np.array_equal(np.array(got[1]["u"], np.float32).view(np.uint32), v.view(np.uint32))
    assert bytes(got[2]["b"]) == b"" and got[2]["u"] == [] and got[3]["b"] is None and got[4]["b"] is None
    assert bytes(got[5]["b"]) == struct.pack("<f", float("nan")) and np.isnan(got[5]["u"][0])
    assert spark.createDataFrame([(bytearray(b"abcde"),)], "b binary").select(packing.unpacked(F.col("b")).alias("u")).first()["u"] is None


def test_rows_come_back_from_tags(spark):
    schema = "message_id long, site_id long, sid long, thread_root_id long, parent_message_id long, text string, created_at timestamp_ntz, is_deleted boolean, embedding array<float>, embedding_version string, more int"
    rows = [(1, 2, 3, 4, None, "ü", datetime(2024, 1, 1, 2, 3, 4, 567891), True, [0.5, -1.25], "v1", 7), (None,) * 11, (1, 2, 3, 4, 9, "", datetime(1969, 12, 31), False, [], None, 0)]
    df = spark.createDataFrame(rows, schema)
    tags = encodings.as_tags(df)
    first = tags.where("parent_message_id = '' and sid = '3'").first()
    assert first["site_id"] == "2" and first["is_deleted"] == "true" and bytes(first["embedding"]) == struct.pack("<2f", 0.5, -1.25) and first["created_at"] == pytest.approx(1704074584.567891)
    assert sorted(map(str, encodings.from_tags(tags, df.schema).collect())) == sorted(map(str, df.collect()))
    seen = {r["created_at"] for r in encodings.as_json(df).collect()}
    assert seen == {"2024-01-01T02:03:04.567891", "1969-12-31T00:00:00", None}
    assert encodings.as_tags(df.limit(0)).count() == 0


def test_source_files(spark, tmp_path):
    (tmp_path / "a.b").mkdir()
    kept = {"a.b/Notes.TXT": b"hello there", "x.tar.gz": b"\x1f\x8b1234567", "env": b"KEY=value", "pic": b"\x89PNG\r\n\x1a\n more text here"}
    for name, data in (kept | {".hidden": b"passed over", "empty": b""}).items():
        (tmp_path / name).write_bytes(data)
    found = files.source_files(spark, str(tmp_path))
    rows = {r["name"]: r for r in found.withColumn("text", files.readable(F.col("content"), F.col("extension"))).collect()}
    assert {n: (r["extension"], r["size"], r["sha256"]) for n, r in rows.items()} == {
        k.split("/")[-1]: (os.path.splitext(k)[1].lower(), len(v), hashlib.sha256(v).hexdigest()) for k, v in kept.items()
    }
    assert {n: r["text"] for n, r in rows.items()} == {"Notes.TXT": "hello there", "x.tar.gz": None, "env": "KEY=value", "pic": None}
    plan = found.select("name", "size")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan


def test_readable_text(spark):
    rows = [
        (1, b"  five\x00\x07 \xffwords\xc2\xa0here \r\n", ".txt"), (2, b"short", None), (3, b"0123456789012345678901234567890PK\x03\x04 not in the head", ""), (4, b"  PK\x03\x04 in the head", ""),
        (5, b"a text for Word", ".DOC"), (6, None, ".txt"), (7, b" " * 300_000 + b"end of it", ".md"), (8, b"\x50\x4b\x03\x54\x00 near", ""), (9, b"\x04\xd5\xa1 half a mark", ""),
    ]
    got = {r["id"]: r["t"] for r in spark.createDataFrame(rows, "id int, c binary, x string").select("id", files.readable(F.col("c"), F.col("x")).alias("t")).collect()}
    assert got == {1: "five wordshere", 2: None, 3: "0123456789012345678901234567890PK\x03\x04 not in the head".replace("\x03", "").replace("\x04", ""), 4: None, 5: None, 6: None, 7: "end of it", 8: "PKT near", 9: "ա half a mark"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_charsets_of_texts_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = files.fit(docs.where(~held))
    every = docs.where(held).withColumn("charset", F.explode(F.array(*[F.lit(c) for c in files.CHARSETS])))
    sent = files.encoded(every.withColumn("k", F.struct("doc_id", "charset")), "k", "text", "charset").cache()
    got = files.decoded(sent, model, "k").withColumnRenamed("text", "found").join(sent.select("k", "text"), "k")
    rows = got.where("length(text) > 1 and text rlike '[^\\\\x00-\\\\x7f]'").groupBy("k.charset").agg(F.count("*").alias("n"), F.count_if(F.col("found") == F.col("text")).alias("ok")).collect()
    assert len(rows) == len(files.CHARSETS) and all(r["ok"] >= 0.95 * r["n"] > 0 for r in rows)


def test_bytes_of_all_kinds(spark):
    learned = spark.createDataFrame([("déjà vu à l'été, où êtes-vous",), (None,), ("",), ("größer über Öl",)], "text string")
    model = files.fit(learned)
    cases = {
        1: (b"plain", "utf-8", "plain"), 2: ("été".encode(), "utf-8", "été"), 3: ("été".encode("utf-8-sig"), "utf-8-sig", "été"), 4: ("été".encode("utf-16"), "utf-16", "été"), 5: (b"", "utf-8", ""), 6: (None, None, None),
        7: ("où êtes-vous, déjà".encode("mac_roman"), "mac_roman", "où êtes-vous, déjà"), 8: ("über größer".encode("utf-16-be"), "utf-16-be", "über größer"), 9: ("über größer".encode("utf-16-le"), "utf-16-le", "über größer"),
        10: ("déjà été ".encode("cp850") * 400_000, "cp850", "déjà été " * 400_000),
    }
    df = spark.createDataFrame([(k, v[0], 1) for k, v in cases.items()] + [(None, b"plain", 1), (1, b"plain", 2)], "file_id int, content binary, text int")
    rows = files.decoded(df, model).collect()
    assert len(rows) == len(cases) + 2
    for r in rows:
        assert (r["charset"], r["text"]) == cases[r["file_id"] or 1][1:]
    assert files.decoded(df.limit(0), files.fit(learned.limit(0))).count() == 0


def test_queries_normalised_as_columns(spark):
    given = ["  a \t b ", "ﬁne　ｗｉｄｅ", "x y z", "", None, "   ", "①²", "tab\x1fsep", "été", "q" * 200_000 + " " * 200_000]
    df = spark.createDataFrame(list(enumerate(given)), "i int, q string")
    want = {i: None if not (q or "").strip() else " ".join(unicodedata.normalize("NFKC", q).split()) for i, q in enumerate(given)}
    assert {r["i"]: r["n"] for r in df.select("i", text.normalized_query(F.col("q")).alias("n")).collect()} == want
    assert want[0] == text.normalize_query(given[0]) and want[1] == text.normalize_query(given[1])


def test_second_pass_sees_what_was_rejected_only(spark):
    asked = []

    def backend(name, good):
        def read(rows):
            ids = rows.select("file_id").collect()
            asked.append((name, sorted(r["file_id"] for r in ids)))
            here = rows.where(F.col("file_id") != 4).select("file_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ordinal"))
            kind = F.element_at(F.array(*[F.lit(k) for k in ("title", "paragraph", "paragraph", "list_item")]), F.col("ordinal") + 1)
            body = F.when(F.col("file_id").isin(good), F.repeat(F.lit("quite a plain sentence here. "), 5))
            return here.select("file_id", "ordinal", kind.alias("type"), body.alias("text"), F.lit(True).alias("has_provenance"), F.lit(False).alias("valid_table"))

        return read

    given = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x"), (None, "x"), (1, "x")], "file_id int, backend string")
    attempts, blocks = extraction.routed(given, [("quick", backend("quick", [1])), ("slow", backend("slow", [2]))])
    assert asked == [("quick", [1, 1, 2, 3, 4]), ("slow", [2, 3, 4])]
    rows = {r["file_id"]: r for r in attempts.collect()}
    assert {k: (r["backend"], r["status"], [a["decision"] for a in r["attempts"]]) for k, r in rows.items()} == {
        1: ("quick", "accepted", ["accept"]), 2: ("slow", "accepted", ["fallback", "accept"]), 3: ("slow", "fallback", ["fallback", "fallback"]), 4: (None, "failed", ["failed", "failed"]),
    }
    assert "low_text" in rows[3]["warnings"] and "text" in rows[2]["attempts"][0]["reasons"]
    assert {(r["file_id"], r["backend"]) for r in blocks.collect()} == {(1, "quick"), (2, "slow"), (3, "slow")}
    attempts, blocks = extraction.routed(given.limit(0), [("quick", backend("quick", []))])
    assert attempts.count() == 0 and blocks.count() == 0
