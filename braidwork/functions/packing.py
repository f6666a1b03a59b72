"""Vectors as bytes: 32-bit floats, least byte first, by expressions alone.

The bits of a number are had by arithmetic: its exponent is the floor of its binary logarithm, put right by one where
that was rounded over a power of two, and its fraction is then a whole number of steps. Signed zeros, numbers below the
normal range and infinities come back as they were; every NaN has the same bits.

A null vector is null, and so is one with a null component; an empty one is an empty binary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a fraction, and the codes of the format: the excess of exponents and the least one.
STEPS, EXCESS, LEAST = 1 << 23, 127, -126
SIGN, INFINITE, NOT_A_NUMBER = 1 << 31, 0x7F800000, 0x7FC00000


def _two_to(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def _bits(vector: Column) -> Column:
    """Of an array of floats, the array of their 32 bits as longs."""
    plain = F.transform(vector, lambda x: F.struct(x.cast("double").alias("x"), F.abs(x.cast("double")).alias("a")))
    finite = lambda z: (z["a"] > 0) & (z["a"] < float("inf"))
    guessed = F.transform(plain, lambda z: F.struct(z["x"].alias("x"), z["a"].alias("a"), F.when(finite(z), F.floor(F.log2(z["a"]))).otherwise(LEAST).cast("int").alias("e")))
    right = lambda z: F.greatest(F.when(z["a"] < _two_to(z["e"]), z["e"] - 1).when(z["a"] >= _two_to(z["e"] + 1), z["e"] + 1).otherwise(z["e"]), F.lit(LEAST))
    exact = F.transform(guessed, lambda z: F.struct(z["x"].alias("x"), z["a"].alias("a"), F.when(finite(z), right(z)).otherwise(LEAST).alias("e")))
    steps = F.transform(exact, lambda z: F.struct(z["x"].alias("x"), z["a"].alias("a"), z["e"].alias("e"), F.when(z["a"] < float("inf"), z["a"] / _two_to(z["e"] - 23)).otherwise(0.0).cast("long").alias("m")))
    sign = lambda z: F.when(z["x"].cast("string").startswith("-"), F.lit(SIGN)).otherwise(F.lit(0)).cast("long")
    size = lambda z: F.when(F.isnan(z["a"]), F.lit(NOT_A_NUMBER)).when(z["a"] == float("inf"), F.lit(INFINITE)).when(z["m"] >= STEPS, (z["e"] + (EXCESS - 1)).cast("long") * STEPS + z["m"]).otherwise(z["m"]).cast("long")
    return F.transform(steps, lambda z: sign(z) + size(z))


def packed(vector: Column) -> Column:
    """An array of floats as binary, four bytes each."""
    pair = lambda h, at: F.substring(h, at, 2)
    digits = F.transform(_bits(vector), lambda b: F.lpad(F.hex(b), 8, "0"))
    turned = F.transform(digits, lambda h: F.concat(pair(h, 7), pair(h, 5), pair(h, 3), pair(h, 1)))
    return F.when(~F.exists(vector, lambda x: x.isNull()), F.unhex(F.array_join(turned, "")))


def unpacked(data: Column) -> Column:
    """The floats of ``packed``; null if the length is no multiple of four."""
    pair = lambda h, at: F.substring(h, at, 2)
    digits = F.regexp_extract_all(F.hex(data), F.lit("[0-9A-F]{8}"), F.lit(0))
    bits = F.transform(digits, lambda h: F.conv(F.concat(pair(h, 7), pair(h, 5), pair(h, 3), pair(h, 1)), 16, 10).cast("long"))
    parts = F.transform(bits, lambda b: F.struct((b >= SIGN).alias("s"), F.shiftright(b, 23).bitwiseAND(F.lit(255)).cast("int").alias("e"), b.bitwiseAND(F.lit(STEPS - 1)).alias("m")))
    sizes = F.transform(
        parts,
        lambda z: F.when(z["s"], -1.0).otherwise(1.0)
        * F.when(z["e"] == 255, F.when(z["m"] == 0, float("inf")).otherwise(float("nan"))).when(z["e"] == 0, z["m"] * _two_to(F.lit(LEAST - 23))).otherwise((z["m"] + STEPS) * _two_to(z["e"] - (EXCESS + 23))),
    )
    return F.when(F.octet_length(data) % 4 == 0, F.transform(sizes, lambda x: x.cast("float")))
