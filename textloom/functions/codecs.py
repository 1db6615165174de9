"""Byte codes for posting lists: variable-byte document numbers and unary frequencies.

Parquet does the compressing in this engine; the codes are here to exchange lists and to report their size.
A value that isn't above zero has no code: null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_byte(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def varbyte_length(n: Column) -> Column:
    """Bytes of the variable-byte code, seven bits each."""
    out = F.lit(1)
    for k in range(1, 9):
        out += F.when(n >= F.lit(1 << (7 * k)), 1).otherwise(0)
    return F.when(n > 0, out)


def unary_length(n: Column) -> Column:
    """Bytes of the unary code: n - 1 set bits after an empty lowest one, at least one byte."""
    return F.when(n > 0, F.greatest(F.lit(1), F.ceil(n / F.lit(8)).cast("int")))


def varbyte_encode(n: Column) -> Column:
    """Base 128, most significant digit first; the highest bit marks the last byte."""
    long = n.cast("long")
    digits = F.transform(F.sequence(varbyte_length(n) - 1, F.lit(0)), lambda k: F.pmod(F.floor(long / F.pow(F.lit(128.0), k)), F.lit(128)).cast("long"))
    last = F.size(digits) - 1
    return F.when(n > 0, F.unhex(F.array_join(F.transform(digits, lambda d, k: _hex_byte(d + F.when(k == last, 128).otherwise(0))), "")))


def unary_encode(n: Column) -> Column:
    """Bits 1 to n - 1 set, in bytes from the lowest."""
    size = unary_length(n)
    full = lambda k: F.least(F.lit(8), F.greatest(F.lit(0), n - 8 * k))  # noqa: E731  bits of byte k below the code's end
    octet = lambda k: (F.pow(F.lit(2), full(k)).cast("int") - F.when(k == 0, 2).otherwise(1))
    return F.when(n > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda k: _hex_byte(F.greatest(F.lit(0), octet(k)))), "")))


def _bytes(code: Column) -> Column:
    """The bytes as an array of ints. The array of one text has it evaluated once."""
    places = lambda text: F.transform(F.sequence(F.lit(1), F.floor(F.length(text) / 2).cast("int")), lambda i: F.conv(F.substring(text, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))
    return F.flatten(F.transform(F.array(F.hex(code)), places))


def varbyte_decode(code: Column) -> Column:
    """A list of codes, one after another -> array<long>."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<long>").alias("out"))

    def take(state: Column, b: Column) -> Column:
        n = state["n"] * 128 + b.bitwiseAND(F.lit(127))
        ends = b >= 128
        return F.struct(F.when(ends, F.lit(0)).otherwise(n).cast("long").alias("n"), F.when(ends, F.concat(state["out"], F.array(n))).otherwise(state["out"]).alias("out"))

    return F.when(F.length(code) > 0, F.aggregate(_bytes(code), start, take, lambda s: s["out"])).otherwise(F.array().cast("array<long>"))


def unary_decode(code: Column) -> Column:
    """One code -> the number: its bits are counted, so that codes of any length come back."""
    return F.aggregate(_bytes(code), F.lit(1), lambda acc, b: acc + F.bit_count(b))
