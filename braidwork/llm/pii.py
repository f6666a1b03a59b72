"""Format-preserving pseudonyms for personal data, with DataFrame expressions only.

A text is split at what looks like personal data; each find is validated (Luhn sum, octets, calendar) and, if
valid, permuted by a keyed Feistel network within its own format: a card number becomes another with a right
check digit, a date another date, and so on. Equal values get equal pseudonyms in all documents, with nothing
to look up, join or shuffle. Addresses of mail and secret tokens, which are not numbers, get keyed hashes.

Each written form of a date is permuted within itself. A date with slashes is read as day/month where that is one, else
as month/day; images of the latter are walked on through the network until they are of its kind again (day above 12),
so no two dates meet. Likewise an SSN is walked on to one with a valid area, group and serial. A telephone number
keeps all but its last seven digits, so its country and area. What is no valid card, address, date or SSN stays;
telephone numbers are validated by their length only, account numbers by IBAN are not looked for.

The Feistel network is over Z_a x Z_b: in turn ``left += f(right) mod a`` and ``right += f(left) mod b``, with f
from SHA-256 of key, kind, round and half, so it permutes any range of a * b values. Whoever has the key can undo
it; keep it secret. It is part of the query plan, so of event logs.

Defined results: a null text stays null and has no find, an empty one stays empty; numbers and dates that are
not valid stay as they are; repeated rows get equal texts; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 10
KINDS = ("email", "secret", "ip", "date", "ssn", "phone", "card")
#: Days from 1900-01-01 to 2098-12-31, as two factors.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 108, 673
#: Steps of a walk at most. Less than half of all images are of the wrong kind, so none needs nearly as many.
WALK = 60
#: A domain name has 127 labels at most. Without that bound the expression engine would go a call deeper for each label of a text.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}",
        r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
        r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
        r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
        r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
        r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?:\+[0-9]{1,3}[ -]?)?(?<![0-9])(?:\([0-9]{3}\)|[0-9]{3})[ -][0-9]{3}[ -][0-9]{4}(?![0-9])",
        r"\+[0-9]{1,3}(?:[ -]?[0-9]){7,12}(?![0-9])",
        r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    ]
)


def feistel(x: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A permutation of 0 .. a * b - 1 (longs, below 2 ** 63)."""
    half = lambda r, v: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), a.cast("string"), r.cast("string"), v.cast("string")), 256), 1, 13), 16, 10).cast("long")
    pair = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        pair(F.call_function("div", x, b), F.pmod(x, b)),
        lambda s, r: F.when(r % 2 == 0, pair(F.pmod(s["l"] + half(r, s["r"]), a), s["r"])).otherwise(pair(s["l"], F.pmod(s["r"] + half(r, s["l"]), b))),
        lambda s: s["l"] * b + s["r"],
    )


def walked(step: Callable[[Column], Column], x: Column, ok: Callable[[Column], Column]) -> Column:
    """The first of step(x), step(step(x)), ... that is ``ok``: permutes the values that are ok, if ``step`` permutes a range that holds them and x is ok."""
    first = F.struct(step(x).alias("v"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), first, lambda a, _: F.when(ok(a["v"]), a).otherwise(F.struct(step(a["v"]).alias("v"))), lambda a: a["v"])


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (2 to 18)."""
    n = F.length(digits)
    low = F.ceil(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("long"), _ten(n - low), _ten(low), key, kind).cast("string"), n, F.lit("0"))


def _is_ssn(x: Column) -> Column:
    """Area not 000 or 666, group not 00, serial not 0000; areas from 900 on are those of taxpayer numbers."""
    area, group, serial = F.floor(x / 1_000_000), F.pmod(F.floor(x / 10_000), F.lit(100)), F.pmod(x, F.lit(10_000).cast("long"))
    return ~area.isin(0, 666) & (group != 0) & (serial != 0)


def permuted_ssn(digits: Column, key: str) -> Column:
    a, b = F.lit(100_000).cast("long"), F.lit(10_000).cast("long")
    return F.lpad(walked(lambda x: feistel(x, a, b, key, "ssn"), digits.cast("long"), _is_ssn).cast("string"), 9, "0")


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the right; ``doubled_first``: the last digit counts twice already."""
    return F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("s"), F.lit(1 if doubled_first else 0).alias("i")),
        lambda a, c: F.struct((a["s"] + F.when(a["i"] == 0, F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.element_at(F.array(*[F.lit(d * 2 - 9 if d > 4 else d * 2) for d in range(10)]), F.coalesce(c.try_cast("int"), F.lit(0)) + 1))).alias("s"), (1 - a["i"]).alias("i")),
        lambda a: a["s"],
    )


def in_format(find: Column, digits: Column) -> Column:
    """``find`` with its digits replaced one by one."""
    return F.aggregate(
        F.split(find, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["out"], F.substring(digits, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))),
        lambda a: a["out"],
    )


def _date_formats(m: Column) -> Column:
    """The format in which a find is a date of the range, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, form in ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}/", "dd/MM/yyyy"), (r"^[0-9]{2}/", "MM/dd/yyyy"), (r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", "dd.MM.yyyy")):
        out = out.when(m.rlike(pattern) & _day(m, form).between(0, DAYS_A * DAYS_B - 1), F.lit(form))
    return out


def _day(m: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))


def _kind(m: Column, digits: Column) -> Column:
    octets = F.split(m, r"\.")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[0-9A-Fa-f]{32,64}$"), "secret")
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.when(F.forall(octets, lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(False))), "ip"))
        .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-|[0-9]{2}/|[0-9]{2}\.[0-9]{2}\.[0-9]{4}$)"), F.when(_date_formats(m).isNotNull(), "date"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(_is_ssn(digits.cast("long")), "ssn"))
        .when(m.rlike(r"^\+|^\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}$"), "phone")
        .when(F.length(digits).between(13, 19) & (luhn_sum(digits, False) % 10 == 0), "card")
    )


def _pseudonym(f: Column, key: str) -> Column:
    m, digits, kind = f["m"], f["digits"], f["kind"]
    n = F.length(digits)
    hashed = lambda: F.sha2(F.concat_ws("|", F.lit(key), kind, m), 256)
    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    ip = feistel(octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    date = F.when(F.lit(False), F.lit(""))
    form = _date_formats(m)
    for x in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy"):
        step = lambda d: feistel(d, F.lit(DAYS_A).cast("long"), F.lit(DAYS_B).cast("long"), key, "date")
        given = _day(m, x).cast("long")
        day = step(given) if x != "MM/dd/yyyy" else walked(step, given, lambda d: F.dayofmonth(F.date_add(F.lit(FIRST_DAY).cast("date"), d.cast("int"))) > 12)
        date = date.when(form == x, F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")), x))
    # Bound once each: a lambda over an array of one value.
    let = lambda v, body: F.element_at(F.transform(F.array(v), body), 1)
    tail = F.least(n, F.lit(7))
    return (
        F.when(kind == "email", F.concat(F.translate(F.substring(hashed(), 1, 12), "0123456789", "ghijklmnop"), F.substring(m, F.instr(m, "@"), F.length(m))))
        .when(kind == "secret", F.substring(F.concat(hashed(), F.sha2(hashed(), 256)), F.lit(1), F.length(m)))
        .when(kind == "ip", let(ip, lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256).cast("long")).cast("string") for s in (24, 16, 8, 0)])))
        .when(kind == "date", date)
        .when(kind == "ssn", in_format(m, permuted_ssn(digits, key)))
        .when(kind == "phone", let(F.concat(F.substring(digits, F.lit(1), n - tail), permuted_digits(F.substring(digits, n - tail + 1, tail), key, "phone")), lambda v: in_format(m, v)))
        .when(
            kind == "card",
            let(
                permuted_digits(F.substring(digits, F.lit(1), n - 1), key, "card"),
                lambda v: in_format(m, F.concat(v, F.pmod(10 - luhn_sum(v, True) % 10, F.lit(10)).cast("string"))),
            ),
        )
        .otherwise(m)
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_found: the finds that were replaced (with underscores before it if there is such a column). Other columns stay."""
    found_, seen_, kinds_, n_found = (unused(docs.columns, c) for c in ("found", "seen", "kinds", "n_found"))
    t = F.col(text)
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    seen = F.transform(F.col(found_), lambda m: F.struct(m.alias("m"), F.regexp_replace(m, "[^0-9]", "").alias("digits")))
    kinds = F.transform(F.col(seen_), lambda f: F.struct(f["m"].alias("m"), f["digits"].alias("digits"), _kind(f["m"], f["digits"]).alias("kind")))
    joined = F.array_join(F.zip_with(F.split(t, PATTERN), F.transform(F.col(kinds_), lambda f: _pseudonym(f, key)), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    out = docs.withColumn(found_, found).withColumn(seen_, seen).withColumn(kinds_, kinds)
    new = F.when(F.size(found_) > 0, joined).otherwise(t)
    return out.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.size(F.filter(kinds_, lambda f: f["kind"].isNotNull())), F.lit(0)).cast("long").alias(n_found))
