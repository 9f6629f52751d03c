"""Integer and fixed-point scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def shr(x: Column, n: int | Column) -> Column:
    """Arithmetic shift right."""
    return F.call_function("shiftright", lit(x), lit(n).cast("int"))


def shl(x: Column, n: int | Column) -> Column:
    return F.call_function("shiftleft", lit(x), lit(n).cast("int"))


def band(x: Column, mask: int | Column) -> Column:
    return lit(x).bitwiseAND(lit(mask))


def round2(x: Column, n: int | Column) -> Column:
    """(x + 2^(n - 1)) >> n; x for n = 0."""
    x, n = lit(x).cast("long"), lit(n).cast("int")
    return F.when(n == 0, x).otherwise(shr(x + shl(F.lit(1).cast("long"), F.greatest(n - 1, F.lit(0))), n))


def round2_signed(x: Column, n: int | Column) -> Column:
    """round2 of the magnitude, with the sign of x."""
    x = lit(x).cast("long")
    return F.when(x >= 0, round2(x, n)).otherwise(-round2(-x, n))


def clip3(lo, hi, x) -> Column:
    return F.greatest(lit(lo), F.least(lit(hi), lit(x)))


def floor_log2(x: Column) -> Column:
    """Place of the highest bit; null for x < 1."""
    return F.when(lit(x) >= 1, F.length(F.bin(lit(x))) - 1)


def ceil_log2(x: Column) -> Column:
    """Least k with 2^k >= x, 0 for x < 2."""
    return F.when(lit(x) < 2, F.lit(0)).otherwise(F.length(F.bin(lit(x) - 1)))


def idiv(x: Column, y: int | Column) -> Column:
    """Integer division towards zero, exact for 64-bit values."""
    x, y = lit(x).cast("long"), lit(y).cast("long")
    return F.call_function("div", x, y)


def constrain(diff: Column, strength: Column, damping: Column) -> Column:
    """CDEF's limit on a difference: full below the strength, falling to zero with the damping shift."""
    diff, strength = lit(diff).cast("long"), lit(strength).cast("long")
    shift = F.greatest(F.lit(0), lit(damping).cast("int") - floor_log2(F.greatest(strength, F.lit(1))))
    size = F.least(F.abs(diff), F.greatest(F.lit(0), strength - shr(F.abs(diff), shift)))
    return F.when(strength == 0, F.lit(0).cast("long")).when(diff < 0, -size).otherwise(size)


def relative_distance(a: Column, b: Column, bits: int | Column) -> Column:
    """Signed distance of order hints modulo 2^bits."""
    m = shl(F.lit(1).cast("long"), lit(bits) - 1)
    d = lit(a).cast("long") - lit(b).cast("long")
    return band(d, m - 1) - band(d, m)


def inverse_recenter(r: Column, v: Column) -> Column:
    r, v = lit(r).cast("long"), lit(v).cast("long")
    return F.when(v > 2 * r, v).when(band(v, 1) != 0, r - shr(v + 1, 1)).otherwise(r + shr(v, 1))


def neg_deinterleave(diff: Column, ref: Column, top: Column) -> Column:
    """Segment id from its coded distance ``diff`` to the predicted ``ref``, below ``top``."""
    diff, ref, top = (lit(x).cast("long") for x in (diff, ref, top))
    odd = band(diff, 1) != 0
    near = F.when(odd, ref + shr(diff + 1, 1)).otherwise(ref - shr(diff, 1))
    low = F.when(diff <= 2 * ref, near).otherwise(diff)
    high = F.when(diff <= 2 * (top - ref - 1), near).otherwise(top - (diff + 1))
    return F.when(ref == 0, diff).when(ref >= top - 1, top - diff - 1).when(2 * ref < top, low).otherwise(high)


def units_in_frame(unit: Column, size: Column) -> Column:
    """Restoration units along a side: round(size / unit), at least one."""
    return F.greatest(idiv(lit(size) + shr(lit(unit).cast("long"), 1), unit), F.lit(1).cast("long"))


def reverse_bits(x: Column, n: int) -> Column:
    """The lowest n bits in reverse order."""
    return sum((shl(band(shr(lit(x).cast("long"), k), 1), n - 1 - k) for k in range(n)), F.lit(0).cast("long"))


def mv_bits(d: Column) -> Column:
    """Approximate bits of a motion vector difference: 1 for none, else 1 + 2 log2(|d| + 2), log2 piecewise linear."""
    v = F.abs(lit(d).cast("long")) + 2
    e = floor_log2(v)
    whole = shl(F.lit(1).cast("long"), e)
    return F.when(lit(d) == 0, F.lit(1.0)).otherwise(1.0 + 2.0 * (e + (v - whole).cast("double") / whole.cast("double")))


def half_away(x: Column) -> Column:
    """Rounds halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)
