"""Operators on 8x8 blocks held as arrays of 64 samples, in raster order: costs, transforms, quantisation, prediction.

All are Column expressions of a row's arrays: a block is compared, transformed or predicted where it is, and
nothing is exploded or shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import fx

N = 8


def fixed(frame: DataFrame, *keys: str, **columns: Column) -> DataFrame:
    """The columns ``keys`` and new ones, each evaluated once a row.

    A function over array elements that refers to an expression evaluates it for every element. The optimiser
    does not move expressions past a generator, so that what later functions refer to is a value.
    """
    return frame.select(*keys, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__row")).select(*keys, "__row.*")


def at(v: Column, i: int, j: int) -> Column:
    return v[i * N + j]


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def total(v: Column) -> Column:
    """Sum as a 64-bit number."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)


def sad(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def sse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")))


def _butterfly(x: list[Column]) -> list[Column]:
    s0, s1, d0, d1 = x[0] + x[1], x[2] + x[3], x[0] - x[1], x[2] - x[3]
    return [s0 + s1, s0 - s1, d0 + d1, d0 - d1]


def hadamard4(d: list[Column]) -> list[Column]:
    """4x4 Hadamard transform of 16 values in raster order."""
    rows = [y for i in range(4) for y in _butterfly(d[4 * i : 4 * i + 4])]
    columns = [_butterfly([rows[4 * i + j] for i in range(4)]) for j in range(4)]
    return [columns[j][i] for i in range(4) for j in range(4)]


#: Signs of the rows of the 4x4 Hadamard matrix in the order that the butterflies give.
HADAMARD = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, 1, -1), (1, -1, -1, 1))


def satd(d: Column) -> Column:
    """Half the sum of absolute 4x4 Hadamard coefficients of a difference block, as one fold over coefficients."""
    quads = F.array(*[F.array(*[at(d, by + i, bx + j) for i in range(4) for j in range(4)]) for by in (0, 4) for bx in (0, 4)])
    signs = F.array(*[F.array(*[F.lit(HADAMARD[i][y] * HADAMARD[j][x]) for y in range(4) for x in range(4)]) for i in range(4) for j in range(4)])
    of = lambda q: F.aggregate(signs, F.lit(0).cast("long"), lambda s, w: s + F.abs(total(F.zip_with(q, w, lambda a, b: a * b))))
    return fx.shr(F.aggregate(quads, F.lit(0).cast("long"), lambda s, q: s + of(q)), 1)


def variance(v: Column, y: int = 0, x: int = 0, size: int = N) -> Column:
    """Population variance of a square of the block."""
    part = F.array(*[at(v, y + i, x + j).cast("long") for i in range(size) for j in range(size)])
    n = size * size
    s, q = total(part), F.aggregate(part, F.lit(0).cast("long"), lambda t, e: t + e * e)
    return q / F.lit(float(n)) - (s / F.lit(float(n))) * (s / F.lit(float(n)))


def basis(n: int = N) -> list[list[float]]:
    """Orthonormal DCT-II: row k is the k-th basis vector."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def transform_2d(frame: DataFrame, key: str, v: Column, matrix: list[list[float]], to: str = "c") -> DataFrame:
    """key and ``to``: matrix . v . matrix^T, rows first, an array of 64 doubles."""
    side = F.array(*[F.array(*[F.lit(x) for x in row]) for row in matrix])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = fixed(frame, key, v=v)
    # half[k][i]: row i with basis vector k
    half = F.transform(side, lambda b: F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: dot(F.slice("v", i * N + 1, F.lit(N)), b)))
    full = F.flatten(F.transform(side, lambda b: F.transform("half", lambda row: dot(row, b))))
    return fixed(fixed(own, key, half=half), key, **{to: full})


def quantise(c: Column, dc_q: float, ac_q: float) -> Column:
    """Levels with a dead zone: DC rounds at one half, AC at 0.62; at most 2^20 - 1."""
    top = float((1 << 20) - 1)
    level = lambda v, q, add: F.least(F.floor(F.abs(v) / q + add), F.lit(top)).cast("long")
    sign = lambda v, n: F.when(v < 0, -n).otherwise(n)
    return F.transform(c, lambda v, k: sign(v, F.when(k == 0, level(v, dc_q, 0.5)).otherwise(level(v, ac_q, 1.0 - 0.62))))


def dequantise(levels: Column, dc_q: int, ac_q: int, denominator: int = 1, depth: int = 8) -> Column:
    """Level times step, wrapped to 24 bits, divided and clamped to the transform's input range."""
    limit = 1 << (7 + depth)

    def one(c: Column, k: Column) -> Column:
        v = c * F.when(k == 0, dc_q).otherwise(ac_q)
        size = fx.idiv(fx.band(F.abs(v), F.lit(0xFFFFFF).cast("long")), denominator)
        return fx.clip3(F.lit(-limit).cast("long"), F.lit(limit - 1).cast("long"), F.when(v < 0, -size).otherwise(size))

    return F.transform(levels, one)


def end_of_block(levels: Column, scan: list[int]) -> Column:
    """One more than the place in the scan of the last level that is not zero."""
    place = {p: k for k, p in enumerate(scan)}
    places = F.array(*[F.lit(place[p]) for p in range(len(scan))])
    return F.array_max(F.zip_with(levels, places, lambda x, k: F.when(x != 0, k + 1).otherwise(0)))


def diagonal_scan(n: int = N) -> list[int]:
    """Places by anti-diagonal, then by row."""
    return [i * n + j for i, j in sorted(((i, j) for i in range(n) for j in range(n)), key=lambda p: (p[0] + p[1], p[0]))]


def inverse_identity(v: Column, n: int) -> Column:
    """Identity transform of 2^n values: powers of the square root of two."""
    if n == 2:
        return F.transform(v, lambda x: fx.round2(x * 5793, 12))
    if n == 4:
        return F.transform(v, lambda x: fx.round2(x * 11586, 12))
    return F.transform(v, lambda x: x.cast("long") * (2 if n == 3 else 4))


def dc_prediction(above: Column, left: Column) -> Column:
    """Rounded mean of the edges that exist; 128 without any. Edges are arrays of 8, or null."""
    n = F.coalesce(F.when(above.isNotNull(), N), F.lit(0)) + F.coalesce(F.when(left.isNotNull(), N), F.lit(0))
    s = F.coalesce(total(above), F.lit(0).cast("long")) + F.coalesce(total(left), F.lit(0).cast("long"))
    return F.when(n == 0, F.lit(128).cast("long")).otherwise(fx.idiv(s + fx.shr(n.cast("long"), 1), F.greatest(n, F.lit(1))))


def paeth(above: Column, left: Column, corner: Column) -> Column:
    """Of left, above and corner the one nearest to left + above - corner, in that order on ties; 64 samples."""

    def one(p: Column) -> Column:
        a, l = above[p % N], left[fx.idiv(p, N).cast("int")]
        base = a + l - corner
        dl, da, dc = F.abs(base - l), F.abs(base - a), F.abs(base - corner)
        return F.when((dl <= da) & (dl <= dc), l).when(da <= dc, a).otherwise(corner)

    return F.transform(F.sequence(F.lit(0), F.lit(N * N - 1)), one)


def chroma_from_luma(dc: Column, luma: Column, mean: Column, alpha: Column, depth: int = 8) -> Column:
    """DC prediction plus alpha / 64 of eight times luma's difference from its mean (eight times it, rounded)."""
    return F.transform(luma, lambda v: fx.clip3(F.lit(0).cast("long"), F.lit((1 << depth) - 1).cast("long"), dc + fx.round2_signed(alpha * (v.cast("long") * 8 - mean), 6)))


def compound_average(a: Column, b: Column, shift: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: fx.round2(x.cast("long") + y, shift))


def mask_blend(a: Column, b: Column, mask: Column) -> Column:
    """(mask a + (64 - mask) b) / 64, rounded."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")))
    return F.zip_with(both, mask, lambda p, m: fx.round2(p["x"] * m + p["y"] * (64 - m), 6))


def palette_cache(above: Column, left: Column) -> Column:
    """Colours of two sorted palettes, merged without repeats."""
    return F.array_sort(F.array_distinct(F.concat(above, left)))


def palette_map(v: Column, colours: Column) -> Column:
    """For each sample the place of the nearest colour, the first one on ties."""
    near = lambda x: F.array_min(F.transform(colours, lambda c, k: F.struct(F.abs(x - c).alias("d"), k.alias("k"))))["k"]
    return F.transform(v, near)


def cfl_alpha(frame: DataFrame, key: str, luma: Column, chroma: Column) -> DataFrame:
    """key, alpha: least-squares scale of luma for chroma, in 64ths, from -16 to 16; null for flat luma."""
    own = fixed(frame, key, l=F.transform(luma, lambda x: x.cast("long") * 8), c=chroma)
    own = fixed(own, key, l=F.col("l"), c=F.col("c"), lm=fx.idiv(total(F.col("l")), 64), cm=fx.idiv(total(F.col("c")), 64))
    num = total(F.zip_with("c", "l", lambda c, x: (c - F.col("cm")) * (x - F.col("lm"))))
    den = F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + (x - F.col("lm")) * (x - F.col("lm")))
    own = own.select(key, num.alias("num"), den.alias("den"))
    return own.select(key, F.when(F.col("den") != 0, fx.clip3(F.lit(-16.0), F.lit(16.0), fx.half_away((64 * F.col("num")).cast("double") / F.col("den"))).cast("int")).alias("alpha"))


#: 840 over the number of samples of a line, 1 to 8.
LINE_WEIGHTS = (0, 840, 420, 280, 210, 168, 140, 120, 105)


def line_of(direction: int, i: int, j: int) -> int:
    """The line of a direction that sample (i, j) of a block is on."""
    return (i + j, i + j // 2, i, 3 + i - j // 2, 7 + i - j, 3 - i // 2 + j, j, i // 2 + j)[direction]


def cdef_direction(frame: DataFrame, key: str, v: Column, weights: tuple[int, ...] = LINE_WEIGHTS) -> DataFrame:
    """key, direction, variance: the direction along whose lines samples vary least, the first on ties."""
    own = fixed(frame, key, x=F.transform(v, lambda s: s.cast("long") - 128))

    def cost(d: int) -> Column:
        lines: dict[int, list[int]] = {}
        for p in range(64):
            lines.setdefault(line_of(d, *divmod(p, 8)), []).append(p)
        sides = F.array(*[F.struct(F.lit(weights[len(ps)]).cast("long").alias("w"), F.array(*[F.lit(p) for p in ps]).alias("ps")) for ps in lines.values()])
        sums = F.transform(sides, lambda g: F.struct(g["w"].alias("w"), F.aggregate(g["ps"], F.lit(0).cast("long"), lambda s, p: s + F.get("x", p)).alias("t")))
        return F.aggregate(sums, F.lit(0).cast("long"), lambda s, g: s + g["t"] * g["t"] * g["w"])

    own = fixed(own, key, cost=F.array(*[cost(d) for d in range(8)]))
    best = F.array_max(F.transform("cost", lambda c, d: F.struct(c.alias("c"), (-d).alias("d"))))
    own = fixed(own, key, cost=F.col("cost"), best=best)
    way = -F.col("best.d")
    return own.select(key, way.alias("direction"), fx.shr(F.col("best.c") - F.get("cost", (way + 4) % 8), 10).alias("variance"))


def scaling_lut(points: Column) -> Column:
    """256 values of the piecewise linear function through points (x, y) with rising x, in 16-bit fixed point."""
    first, last = points[0], F.element_at(points, -1)

    def value(x: Column) -> Column:
        below = F.filter(points, lambda p: p["x"] <= x)
        a, b = F.element_at(below, -1), points[F.size(below)]
        dx = (b["x"] - a["x"]).cast("long")
        delta = (b["y"] - a["y"]) * fx.idiv(65536 + fx.shr(dx, 1), dx)
        return F.when(x < first["x"], first["y"].cast("long")).when(x >= last["x"], last["y"].cast("long")).otherwise(a["y"] + fx.shr((x - a["x"]) * delta + 32768, 16))

    return F.transform(F.sequence(F.lit(0), F.lit(255)), value)
