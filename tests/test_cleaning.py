"""Broken encodings and entities."""

from __future__ import annotations

import html
import os

import pytest
from pyspark.sql import functions as F

from braidwork.functions import text as x

SF = "/root/testdata/sf0.001"


def windows(b):
    """Bytes as Windows-1252, with the five bytes it leaves open as they are."""
    return "".join(bytes([k]).decode("cp1252") if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(k) for k in b)


CHAINS = {"latin-1": lambda t: t.encode().decode("latin-1"), "windows": lambda t: windows(t.encode()), "twice": lambda t: windows(windows(t.encode()).encode()), "mixed": lambda t: t.encode().decode("latin-1").encode().decode("latin-1")}


def through(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize("chain", CHAINS)
def test_broken_texts_come_back(spark, chain):
    texts = ["café crème", "l’été – déjà “vu” …", "Straße für Älteste", "naïve 100 €", "Привет мир", "日本語のテキスト", "Łódź źrebię", "ok 😀 é", "plain", "", "x" * 50_000 + "é" * 50_000]
    assert through(spark, [CHAINS[chain](t) for t in texts], x.repaired) == texts


def test_right_texts_stay(spark):
    texts = ["café", "«CAFÉ»", "“CAFÉ” Ñ™", "Â", "Ã o", "à «b»", "100 €", "Ünï", "Привет", "日本", "ê" * 1000, "ÄÖ»", "Ã", None]
    assert through(spark, texts, x.repaired) == texts


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_texts_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").where("text is not null")
    assert docs.where(x.repaired(F.col("text")) != F.col("text")).count() == 0
    marked = [r[0] for r in docs.where(F.col("text").rlike(r"[^\x00-\x7f]")).collect()]
    for chain in CHAINS.values():
        assert marked and through(spark, [chain(t) for t in marked], x.repaired) == marked


def test_entities(spark):
    texts = ["&eacute;t&eacute; &#8217; &#x1F600; &amp;lt; &lt;b&gt; &nosuch; & &; &#0; &#xD800; &#1114112; R&D &copy", "a&b;c", "&" * 100_000, "&#39;" * 20_000, "no", "", None]
    want = ["été ’ 😀 &lt; <b> &nosuch; & &; � � � R&D &copy", "a&b;c", "&" * 100_000, "'" * 20_000, "no", "", None]
    assert through(spark, texts, x.unescaped) == want
    named = [f"&{k};" for k in ("Alpha", "hearts", "yuml", "thetasym", "frac12", "nbsp")]
    assert through(spark, named, x.unescaped) == [html.unescape(t) for t in named]
    assert through(spark, ["CafÃ© &amp; <b>cr&egrave;me</b> 😀&nbsp;now"], x.clean_message) == ["Café & crème now"]
