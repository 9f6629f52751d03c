"""Bit-level reads as Column expressions over BINARY: most significant bit first, as in bit streams.

A read that goes beyond the data gives null, never zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions import fx


def f(data: Column, at: Column | int, n: Column | int) -> Column:
    """Unsigned number in the n (at most 32) bits from bit ``at`` on."""
    at, n = fx.lit(at).cast("int"), fx.lit(n).cast("int")
    first, last = fx.shr(at, 3), fx.shr(at + n - 1, 3)
    taken = F.conv(F.hex(F.substring(data, first + 1, last - first + 1)), 16, 10).cast("long")
    value = fx.band(fx.shr(taken, (last + 1) * 8 - (at + n)), fx.shl(F.lit(1).cast("long"), n) - 1)
    return F.when(at + n > 8 * F.length(data), None).when(n == 0, F.lit(0).cast("long")).otherwise(value)


def su(data: Column, at: Column | int, n: Column | int) -> Column:
    """Signed number in n bits, two's complement."""
    value, sign = f(data, at, n), fx.shl(F.lit(1).cast("long"), fx.lit(n) - 1)
    return F.when(fx.band(value, sign) != 0, value - 2 * sign).otherwise(value)


def ns(data: Column, at: Column | int, n: Column | int) -> Column:
    """Non-symmetric code of a number below n: w - 1 bits, one more for the larger values."""
    n, at = fx.lit(n).cast("long"), fx.lit(at).cast("int")
    w = F.length(F.bin(n)).cast("int")
    m = fx.shl(F.lit(1).cast("long"), w) - n
    v = f(data, at, w - 1)
    return F.when(v < m, v).otherwise(fx.shl(v, 1) - m + f(data, at + w - 1, 1))


def uvlc(data: Column, at: int = 0) -> Column:
    """Exp-Golomb-like code; 2^32 - 1 from 32 leading zeros on, null beyond 40 or past the end."""
    bits = F.substring(F.lpad(F.conv(F.hex(F.substring(data, 1, 8)), 16, 2), 64, "0"), at + 1, 64 - at)
    zeros = F.locate("1", bits) - 1
    value = f(data, zeros + at + 1, zeros)
    top = F.lit((1 << 32) - 1).cast("long")
    return F.when((zeros < 0) | (zeros > 40), None).when(zeros >= 32, top).otherwise(fx.shl(F.lit(1).cast("long"), F.least(zeros, F.lit(32))) - 1 + F.coalesce(value, F.lit(None).cast("long")))


def leb128(data: Column, at: Column | int = 1) -> Column:
    """struct(value, size) of the little-endian base-128 number from byte ``at`` (from 1); null without an end in 8 bytes."""
    at = fx.lit(at).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.hex(F.substring(data, at + k, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(s: Column, b: Column) -> Column:
        more = F.struct((s["value"] + fx.shl(fx.band(b, 127), s["size"] * 7)).alias("value"), (s["size"] + 1).alias("size"), (b < 128).alias("done"))
        return F.when(s["done"] | b.isNull(), s).otherwise(more)

    read = F.aggregate(bytes_, start, step)
    return F.when(read["done"], F.struct(read["value"].alias("value"), read["size"].alias("size")))


def leb128_bytes(value: Column) -> Column:
    """The shortest code of a non-negative number, as BINARY."""
    groups = F.greatest(F.ceil(F.length(F.bin(value)) / 7).cast("int"), F.lit(1))
    one = lambda k: F.lpad(F.hex(fx.band(fx.shr(value, 7 * k), 127) + F.when(k < groups - 1, 128).otherwise(0)), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), one), ""))


def packed(fields: Column) -> Column:
    """BINARY of array<struct<n, v>>: v in n bits each, then a one bit and zeros to the next byte."""
    bits = F.array_join(F.transform(fields, lambda x: F.when(x["n"] > 0, F.lpad(F.bin(x["v"]), x["n"], "0")).otherwise("")), "")
    closed = F.concat(bits, F.lit("1"))
    whole = F.rpad(closed, (F.ceil(F.length(closed) / 8) * 8).cast("int"), "0")
    octets = F.transform(F.sequence(F.lit(0), (F.length(whole) / 8).cast("int") - 1), lambda k: F.lpad(F.conv(F.substring(whole, k * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.unhex(F.array_join(octets, ""))


def lfsr16(seed: Column, steps: Column | int) -> Column:
    """States of the 16-bit register with taps 0, 1, 3 and 12, after each of 1 to ``steps`` shifts."""

    def shift(states: Column, _: Column) -> Column:
        r = F.element_at(states, -1)
        bit = fx.band(r.bitwiseXOR(fx.shr(r, 1)).bitwiseXOR(fx.shr(r, 3)).bitwiseXOR(fx.shr(r, 12)), 1)
        return F.concat(states, F.array(fx.shr(r, 1) + fx.shl(bit, 15)))

    states = F.aggregate(F.sequence(F.lit(1), fx.lit(steps)), F.array(seed.cast("long")), shift)
    return F.slice(states, F.lit(2), fx.lit(steps))
