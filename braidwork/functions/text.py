"""Text functions and predicates as columns. Patterns are Unicode-aware where word and blank classes matter."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P


def _any(text: Column, found: tuple[str, ...]) -> Column:
    return reduce(or_, [text.rlike("(?iU)" + p) for p in found])


def collapsed(text: Column) -> Column:
    """Blanks of any kind to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_query(text: str | None) -> str:
    """NFKC, one space between words; an empty query is an error."""
    out = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").strip())
    if not out:
        raise ValueError("the query is empty")
    return out


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def normalized_query(text: Column) -> Column:
    """``normalize_query`` as a column; an empty or null query is null. Only texts beyond ASCII leave the JVM's functions, as these have no NFKC."""
    blank = lambda t: F.trim(F.regexp_replace(t, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))
    beyond = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.nullif(blank(F.coalesce(_compatible(beyond), text)), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _pieces(text: Column, pattern: str, replaced: Callable[[Column], Column]) -> Column:
    """The text with what matches replaced: it is cut into the matches and what lies between, in one pass."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)({pattern}|.)"), F.lit(1))
    return F.array_join(F.transform(found, replaced), "")


def unescaped(text: Column) -> Column:
    """Entities of HTML 4 and numbers of characters as the characters, once; what is no entity stays.

    A number that is no character (0, surrogates, beyond Unicode) is U+FFFD."""
    names = F.create_map(*[F.lit(v) for name, point in name2codepoint.items() for v in (f"&{name};", chr(point))])

    def character(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#([0-9]{1,7});$", 1)
        hexed = F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        point = F.coalesce(F.nullif(digits, F.lit("")).cast("long"), F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("long"))
        known = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(F.when(known, point).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(~piece.startswith("&") | (F.length(piece) < 3), piece).when(point.isNotNull(), number).otherwise(F.coalesce(F.try_element_at(names, piece), piece))

    return F.when(text.contains("&"), _pieces(text, "[^&]+|&#?[0-9A-Za-z]{1,31};", character)).otherwise(text)


#: The characters of Windows-1252 for the bytes 80 to 9F that it gives another meaning.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_NEXT = f"[\u0080-¿{WINDOWS}]"
#: What UTF-8 looks like if its bytes are read as Latin-1 or Windows-1252. Sequences that begin with an accented A, or are
#: longer than two, are sure; those of two that begin with another capital may be right text, such as a name in quotes.
_SURE = f"[ÂÃ]{_NEXT}|[à-ï]{_NEXT}{{2}}|[ð-ô]{_NEXT}{{3}}"
_OTHER = f"[Ä-ß]{_NEXT}"
_IN_A_ROW = f"(?:{_OTHER}){{3}}"


def repaired(text: Column) -> Column:
    """The text without what reading UTF-8 as Latin-1 or Windows-1252 has done to it, once or twice; right text stays.

    Each sequence of characters that spells the bytes of one character becomes that character. Sequences of two that begin with a
    capital other than an accented A count only if the text has three in a row, or sure ones besides; when in doubt all stays."""
    return _repaired(_repaired(text))


def _repaired(text: Column) -> Column:
    def character(piece: Column) -> Column:
        seen = piece.rlike(f"^(?:{_SURE}|{_OTHER})$")
        raw = F.encode(F.when(seen, F.translate(piece, WINDOWS, _BYTES)).otherwise(F.lit("")), "ISO-8859-1")
        return F.when(seen, F.coalesce(F.try_validate_utf8(raw.cast("string")), piece)).otherwise(piece)

    whole = _pieces(text, f"{_SURE}|{_OTHER}|[^Â-ô]+", character)
    return F.when(text.rlike(f"{_SURE}|{_IN_A_ROW}"), whole).otherwise(text)


def clean_message(text: Column) -> Column:
    """Broken encoding mended, emoji out, entities to characters, tags out, blanks collapsed; null is empty."""
    out = F.regexp_replace(repaired(F.coalesce(text, F.lit(""))), P.EMOJI, "")
    return collapsed(without_tags(unescaped(out)))


def without_tags(text: Column) -> Column:
    """Without ``<...>``. What comes after the last ``>`` has no tag, and is not searched for one at each ``<``."""
    rest = F.substring_index(text, ">", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
    return F.concat(F.regexp_replace(head, r"<[^>]+>", ""), rest)


def emoji_only(text: Column) -> Column:
    return (collapsed(text) != "") & (collapsed(F.regexp_replace(text, P.EMOJI, "")) == "")


def is_noise(cleaned: Column, original: Column) -> Column:
    """Empty, emoji alone, no letter, or fewer than two words."""
    return F.coalesce((cleaned == "") | emoji_only(original) | ~cleaned.rlike("[a-zA-ZÀ-ɏ]") | (F.size(F.split(cleaned, " ")) < 2), F.lit(True))


def lenient_json(text: Column) -> Column:
    """A variant of a JSON object or array, after a second try with control characters escaped; else null."""
    t = collapsed_ends(text)
    fixed = t
    for raw, escaped in (("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t"), ("\b", r"\b"), ("\f", r"\f")):
        fixed = F.replace(fixed, F.lit(raw), F.lit(escaped))
    fixed = F.regexp_replace(fixed, r"[\x00-\x1f]", "")
    return F.when(t.rlike(r"^[{\[]"), F.coalesce(F.try_parse_json(t), F.try_parse_json(fixed)))


#: All characters with the property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def collapsed_ends(text: Column) -> Column:
    """No blanks of any kind at the ends, in one pass: a pattern for the end of a text would start anew at each blank."""
    return F.trim(text, F.lit(BLANKS))


def message_text(text: Column) -> Column:
    """The first of text, msg and message that isn't blank, of a JSON object; else the raw message."""
    v = lenient_json(text)
    got = [F.try_variant_get(v, f"$.{k}", "string") for k in ("text", "msg", "message")]
    return F.coalesce(*[F.when(collapsed_ends(g) != "", g) for g in got], text)


def attachments(text: Column) -> Column:
    """Array of (link, item as JSON) of a JSON message: its items, those of ``msg``, or itself, if they are objects with
    a link; a file id stands in for a blank link. Anything else, null too, has none."""
    v = lenient_json(text)
    whole = F.try_variant_get(v, "$", "variant")
    many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.msg", "array<variant>"))
    msg = F.try_variant_get(v, "$.msg", "variant")
    items = F.coalesce(many, F.array(F.when(_is_object(msg), msg).otherwise(whole)))
    of = lambda i, k: F.nullif(F.try_variant_get(i, f"$.{k}", "string"), F.lit(""))
    link = lambda i: F.coalesce(of(i, "link"), of(i, "fileid"), of(i, "fileId"))
    found = F.transform(F.filter(items, lambda i: F.coalesce(_is_object(i), F.lit(False))), lambda i: F.struct(link(i).alias("link"), F.to_json(i).alias("item")))
    return F.coalesce(F.filter(found, lambda x: x["link"].isNotNull()), F.array().cast("array<struct<link:string,item:string>>"))


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def document_id(content_hash: Column, file_id: Column) -> Column:
    """By content where its hash is known, else by file."""
    return F.concat(F.lit("document:"), F.coalesce(content_hash, file_id.cast("string")))


def display_name(first: Column, last: Column, username: Column) -> Column:
    full = F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))))
    tail = F.substring_index(F.substring_index(username, "[V]", -1), "_", -1)
    return F.when(full != "", full).when(F.coalesce(tail, F.lit("")) != "", tail).otherwise(F.lit("User"))


def is_meta_response(text: Column) -> Column:
    t = F.lower(collapsed_ends(F.coalesce(text, F.lit(""))))
    short = F.size(F.split(collapsed(t), " ")) <= 15
    search, process = t.rlike("search|websearch|web_search|lookup"), t.rlike("process|processing|tool|request")
    return (t == "") | _any(t, P.META_RESPONSE) | (short & search & process)


def is_inquiry(text: Column) -> Column:
    t = collapsed_ends(F.coalesce(text, F.lit("")))
    return F.when((t == "") | _any(t, P.UPGRADE), False).when(t.endswith("?"), True).otherwise(_any(t, P.QUESTION_START) | _any(t, P.INQUIRY))


def is_send_action(text: Column) -> Column:
    t = collapsed_ends(F.coalesce(text, F.lit("")))
    return F.when((t == "") | _any(t, P.UPGRADE), False).otherwise(_any(t, P.SEND_ACTION))


def send_recipient(text: Column) -> Column:
    """Whom a message is to be sent to; a leading "my" becomes "your"; null if nobody is named."""
    got = collapsed_ends(F.regexp_extract(text, "(?iU)" + P.RECIPIENT, 1))
    return F.when(got == "", None).when(F.lower(got).startswith("my "), F.concat(F.lit("your "), F.substring(got, F.lit(4), F.length(got)))).otherwise(got)


def personalized(text: Column, name: str) -> Column:
    return F.regexp_replace(text, r"(?iU)\b" + re.sub(r"([^\w\s])", r"\\\1", name) + r"\b", "you")


def is_list_item(text: Column) -> Column:
    return text.rlike(r"^(•|-|\*|[0-9][.)])")


def is_suspicious(text: Column) -> Column:
    """A word that ends in "percent" or in a function word: one word character before the ending is enough to know."""
    return _any(text, P.SUSPICIOUS)


def numeric_tokens(text: Column) -> Column:
    """How many blank-separated tokens look like numbers."""
    return F.size(F.filter(F.split(collapsed(text), " "), lambda t: F.regexp_replace(t, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "").rlike(P.NUMERIC)))


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, trimmed, without empty ones."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(F.transform(F.split(unix, "\n\n"), collapsed_ends), lambda p: p != "")


def prose_normalized(text: Column) -> Column:
    """Lower case, without list marks, numbering and punctuation, for comparing extractions."""
    # Blanks before a mark are those of its own line: lines before it go when blanks collapse.
    out = F.regexp_replace(F.lower(text), r"(?m)^[ \t\x0b\f]*(?:[•*-]|[0-9]+\.)\s+", "")
    return collapsed(F.regexp_replace(out, r"(?U)[^\w\s]", ""))


def token_estimate(text: Column) -> Column:
    """The default token counter: a token for four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")
