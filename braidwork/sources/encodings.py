"""Two physical encodings of a search document: one for stores of JSON documents, one for stores of flat fields.

``as_json``: ids of sites, threads and authors as strings, times in ISO 8601, vectors as arrays.
``as_tags``: ids as tags (strings), times as seconds since 1970, booleans as words, vectors packed into bytes, an empty string
for what is null; ``from_tags`` takes such a row back. A text is left as it is in both. Strings that are empty come back as null
from tags, as the two can't be told apart there. Columns that a table lacks are left out; further ones are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions.packing import packed, unpacked

STRING_IDS = ("site_id", "thread_root_id", "author_archive_id")
TAGS = ("site_id", "sid", "author_archive_id", "thread_root_id", "parent_message_id")
TIMES = ("created_at", "updated_at")
FLAGS = ("is_thread_reply", "is_deleted", "is_edited")
WORDS = ("channel_type", "embedding_version")
MICROS = 1_000_000


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def as_json(docs: DataFrame) -> DataFrame:
    has = [c for c in (*STRING_IDS, *TIMES) if c in docs.columns]
    iso = lambda c: F.when(_micros(F.col(c)) % MICROS == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return docs.withColumns({c: iso(c) if c in TIMES else F.col(c).cast("string") for c in has})


def as_tags(docs: DataFrame) -> DataFrame:
    has = lambda names: [c for c in names if c in docs.columns]
    out = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in has((*TAGS, *WORDS, *FLAGS))}
    out |= {c: _micros(F.col(c)) / MICROS for c in has(TIMES)}
    out |= {c: packed(F.col(c)) for c in has(("embedding",))}
    return docs.withColumns(out)


def from_tags(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of ``as_tags`` with the columns and types of ``schema``. Times are right to the microsecond up to the year 2200."""

    def back(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name in TIMES:
            at = F.timestamp_micros(F.round(c * MICROS).cast("long"))
            return at.cast(f.dataType)
        if f.name == "embedding":
            return unpacked(c).cast(f.dataType)
        return F.nullif(c, F.lit("")).cast(f.dataType) if f.name in (*TAGS, *WORDS, *FLAGS) else c.cast(f.dataType)

    return rows.select(*[back(f).alias(f.name) for f in schema.fields])
