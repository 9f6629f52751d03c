"""Frame filters, grain and searches over filters (F11, H, I, K18-K22), on the block view in long form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import adapters as A, bits, fx
from tessera.operators import blocks as B, frames as R, kernels, planes as P
from tessera.plans.registry import query
from tessera.plans.scalars import WITH as DIGESTS, _hex

WITH = f"WITH {A.PIXELS.replace('pixels AS (', 'pixels AS MATERIALIZED (')}"


_DIGEST = "SELECT frame, CAST(sum(o) AS BIGINT) AS total, CAST(sum(o * (y * 80 + x + 1)) AS BIGINT) AS weighted FROM {t} GROUP BY frame"


def _fir_sql(source: str, value: str, along: str, taps: list[int], to: str) -> str:
    """SQL of a filter along an axis with clamped ends."""
    across, most = ("y", 79) if along == "x" else ("x", 39)
    weights = ", ".join(f"({k - len(taps) // 2}, {t})" for k, t in enumerate(taps))
    return f"{to} AS (SELECT a.frame, a.y, a.x, a.s, CAST(sum(b.{value} * w) AS BIGINT) AS f FROM {source} a, (VALUES {weights}) w(k, w), {source} b WHERE b.frame = a.frame AND b.{across} = a.{across} AND b.{along} = greatest(0, least({most}, a.{along} + k)) GROUP BY a.frame, a.y, a.x, a.s)"


TAPS = R.filter_taps()
_TAPS = ", ".join(f"({f}, {k}, {w})" for f, row in enumerate(TAPS) for k, w in enumerate(row))


@query("f11_interpolation", f"{WITH}, w AS (SELECT * FROM (VALUES {_TAPS}) t(f, k, w)), h AS (SELECT a.frame, a.y, a.x, a.blk, d.k AS ky, d.w AS wy, (CAST(sum(t.w * b.s) AS BIGINT) + 4) >> 3 AS h FROM pixels a JOIN w d ON d.f = a.blk % 50 // 16 % 16 JOIN w t ON t.f = a.blk % 50 % 16 JOIN pixels b ON b.frame = a.frame AND b.y = greatest(0, least(39, a.y + d.k - 3)) AND b.x = greatest(0, least(79, a.x + t.k - 3)) GROUP BY ALL), r AS (SELECT frame, y, x, greatest(0, least(255, (CAST(sum(wy * h) AS BIGINT) + 1024) >> 11)) AS o FROM h GROUP BY frame, y, x) {_DIGEST.format(t='r')}")
def interpolation(spark: SparkSession, folder: str) -> DataFrame:
    """Samples between samples, both ways: the phases of a block (its number modulo 16, and over 16) choose among filters of eight taps."""

    def run(samples, there):
        number = np.arange(samples.size // 64).reshape(samples.shape[0] // 8, samples.shape[1] // 8)
        return R.interpolated(samples, number // 16 % 16, number % 16, TAPS)

    return R.digests(A.blocks(spark, folder), run)


VERTICAL, HORIZONTAL = [3, -7, 15], [2, -9, 20]


@query("h10_wiener", f"{WITH}, {_fir_sql('pixels', 's', 'x', P.wiener_taps(HORIZONTAL), 'h')}, g AS (SELECT frame, y, x, s, greatest(-2048, least(8191 - 2048, (f + 4) >> 3)) AS t FROM h), {_fir_sql('g', 't', 'y', P.wiener_taps(VERTICAL), 'v')}, r AS (SELECT frame, y, x, greatest(0, least(255, (f + 1024) >> 11)) AS o FROM v) {_DIGEST.format(t='r')}")
def wiener(spark: SparkSession, folder: str) -> DataFrame:
    return R.digests(A.blocks(spark, folder), _wiener)


def _wiener(samples, there):
    return R.wiener(samples, there, P.wiener_taps(VERTICAL), P.wiener_taps(HORIZONTAL))


_WIENER = f"{_fir_sql('pixels', 's', 'x', P.wiener_taps(HORIZONTAL), 'h')}, g AS (SELECT frame, y, x, s, greatest(-2048, least(8191 - 2048, (f + 4) >> 3)) AS t FROM h), {_fir_sql('g', 't', 'y', P.wiener_taps(VERTICAL), 'v')}"


@query("h9_restoration", f"{WITH}, {_WIENER}, r AS (SELECT frame, y, x, CASE WHEN x // 40 % 2 = 1 THEN greatest(0, least(255, (f + 1024) >> 11)) ELSE s END AS o FROM v) {_DIGEST.format(t='r')}")
def restoration(spark: SparkSession, folder: str) -> DataFrame:
    """Units of 40 columns: every other one is restored by the symmetric filter, which looks across the units' borders."""
    return R.digests(A.blocks(spark, folder), lambda samples, there: R.restored(samples, _wiener(samples, there), 40, lambda unit: unit % 2 == 1))


GUIDES, SHARES = (140, 3236), (31, 64)


def _box_sql(name: str, radius: int, strength: int, row: str, shift: str) -> str:
    n = (2 * radius + 1) ** 2
    return f"""{name}k AS MATERIALIZED (SELECT frame, y, x, greatest(0, least(39, y + dy)) AS ny, greatest(0, least(79, x + dx)) AS nx FROM grid, (SELECT unnest(range(-{radius}, {radius + 1})) AS dy), (SELECT unnest(range(-{radius}, {radius + 1})) AS dx)),
{name}b AS (SELECT g.frame, g.y, g.x, CAST(sum(b.s) AS BIGINT) AS t, CAST(sum(b.s * b.s) AS BIGINT) AS q FROM {name}k g JOIN pixels b ON b.frame = g.frame AND b.y = g.ny AND b.x = g.nx GROUP BY ALL),
{name}z AS (SELECT *, (greatest(0, q * {n} - t * t) * {strength} + 524288) >> 20 AS z FROM {name}b), {name}a AS (SELECT frame, y, x, t, CASE WHEN z >= 255 THEN 256 WHEN z = 0 THEN 1 ELSE (z * 256 + z // 2) // (z + 1) END AS a FROM {name}z),
{name}m AS MATERIALIZED (SELECT frame, y, x, a, ((256 - a) * t * {(4096 + n // 2) // n} + 2048) >> 12 AS b FROM {name}a),
{name}n AS MATERIALIZED (SELECT frame, y, x, s, y + dy AS ny, x + dx AS nx, {row} AS w FROM pixels p, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
{name} AS MATERIALIZED (SELECT frame, y, x, s, (a * s + b + (1 << ({shift} - 1))) >> {shift} AS f FROM (SELECT p.frame, p.y, p.x, p.s, CAST(sum(w * m.a) AS BIGINT) AS a, CAST(sum(w * m.b) AS BIGINT) AS b FROM {name}n p JOIN {name}m m ON m.frame = p.frame AND m.y = p.ny AND m.x = p.nx GROUP BY p.frame, p.y, p.x, p.s))"""


@query("h11_self_guided", f"{WITH}, grid AS MATERIALIZED (SELECT frame, y, x FROM (SELECT DISTINCT frame FROM pixels), (SELECT unnest(range(-1, 41)) AS y), (SELECT unnest(range(-1, 81)) AS x)), {_box_sql('f0', 2, GUIDES[0], 'CASE WHEN (y + dy + 2) % 2 = 1 THEN CASE WHEN dx = 0 THEN 6 ELSE 5 END ELSE 0 END', 'CAST(9 - y % 2 AS INTEGER)')}, {_box_sql('f1', 1, GUIDES[1], 'CASE WHEN dy = 0 OR dx = 0 THEN 4 ELSE 3 END', '9')}, r AS (SELECT f0.frame, f0.y, f0.x, greatest(0, least(255, ({SHARES[1]} * (f0.s * 16) + {SHARES[0]} * f0.f + {128 - sum(SHARES)} * f1.f + 1024) >> 11)) AS o FROM f0 JOIN f1 ON f1.frame = f0.frame AND f1.y = f0.y AND f1.x = f0.x) {_DIGEST.format(t='r')}")
def self_guided(spark: SparkSession, folder: str) -> DataFrame:
    """Both box filters and their projection, with strengths and weights given."""
    return R.digests(A.blocks(spark, folder), lambda samples, there: R.self_guided(samples, there, GUIDES, SHARES))


@query("h11_box_filter", f"{WITH}, b AS (SELECT a.frame, a.y, a.x, a.s, count(*) AS n, CAST(sum(b.s) AS BIGINT) AS t, CAST(sum(b.s * b.s) AS BIGINT) AS q FROM pixels a JOIN pixels b ON b.frame = a.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL), z AS (SELECT *, (greatest(0, q * n - t * t) * 140 + 524288) >> 20 AS z FROM b), r AS (SELECT frame, y, x, CASE WHEN z >= 255 THEN 256 WHEN z = 0 THEN 1 ELSE (z * 256 + z // 2) // (z + 1) END AS o FROM z) {_DIGEST.format(t='r')}")
def box_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the self-guided filter with radius 1, from the sums of the samples that a box has."""
    return R.digests(A.blocks(spark, folder), lambda samples, there: R.box_guides(samples, there, 140))


LIMITS = (20, 60, 2, 12)  # of neighbours, of the edge, of high variance, of what is flat


def _edge_sql(source: str, name: str, size: int, along: str = "x") -> str:
    """SQL of the filter across edges along an axis: ``name`` has what it gives, ``name``g a row for each edge sample."""
    limit, blimit, thresh, flat = LIMITS
    across, reach, step = "y" if along == "x" else "x", {4: 4, 6: 4, 8: 4, 16: 7}[size], max(size, 8)
    at = lambda k: f"q{k}" if k >= 0 else f"p{-1 - k}"
    c = lambda x: f"greatest(-128, least(127, {x}))"
    near = {4: 2, 6: 3, 8: 4, 16: 4}[size]
    gaps = [f"abs(q{k} - q{k - 1}) <= {limit} AND abs(p{k} - p{k - 1}) <= {limit}" for k in range(1, near)]
    level = lambda first, last: " AND ".join(f"abs(q{k} - q0) <= {flat} AND abs(p{k} - p0) <= {flat}" for k in range(first, last))
    wide = {4: [], 6: [(2, 3, 1, level(1, 3))], 8: [(3, 3, 0, level(1, 4))], 16: [(6, 4, 1, f"{level(1, 4)} AND {level(4, 7)}"), (3, 3, 0, level(1, 4))]}[size]
    narrow = {0: f"CASE WHEN mask THEN {c('q0 - 128 - f1')} + 128 ELSE q0 END", -1: f"CASE WHEN mask THEN {c('p0 - 128 + f2')} + 128 ELSE p0 END", 1: f"CASE WHEN mask AND NOT hev THEN {c('q1 - 128 - ((f1 + 1) >> 1)')} + 128 ELSE q1 END", -2: f"CASE WHEN mask AND NOT hev THEN {c('p1 - 128 + ((f1 + 1) >> 1)')} + 128 ELSE p1 END"}

    def value(k: int) -> str:
        cases = []
        for n, bits, double, where in wide:
            if -n <= k < n:
                total = " + ".join(f"{2 if abs(j) <= double else 1} * {at(min(max(k + j, -n - 1), n))}" for j in range(-n, n + 1))
                cases.append(f"WHEN mask AND {where} THEN ({total} + {1 << bits - 1}) >> {bits}")
        return f"CASE {' '.join(cases)} ELSE {narrow.get(k, at(k))} END" if cases else narrow.get(k, at(k))

    taps = range(-max([n for n, *_ in wide], default=2), max([n for n, *_ in wide], default=2))
    columns = ", ".join([f"lag(s, {k + 1}) OVER w AS p{k}" for k in range(reach)] + [f"lead(s, {k}) OVER w AS q{k}" for k in range(reach)])
    return f"""{name}e AS (SELECT frame, y, x, {columns} FROM {source} WINDOW w AS (PARTITION BY frame, {across} ORDER BY {along})),
{name}m AS (SELECT *, abs(p1 - p0) > {thresh} OR abs(q1 - q0) > {thresh} AS hev, {' AND '.join(gaps)} AND abs(p0 - q0) * 2 + (abs(p1 - q1) >> 1) <= {blimit} AS mask FROM {name}e WHERE {along} % {step} = 0 AND {along} > 0),
{name}f AS (SELECT *, {c('CASE WHEN hev THEN ' + c('p1 - q1') + ' ELSE 0 END + 3 * (q0 - p0)')} AS f FROM {name}m), {name}g AS (SELECT *, {c('f + 4')} >> 3 AS f1, {c('f + 3')} >> 3 AS f2 FROM {name}f),
{name}u AS (SELECT frame, {across}, {along} + unnest([{', '.join(str(k) for k in taps)}]) AS {along}, unnest([{', '.join(value(k) for k in taps)}]) AS n FROM {name}g),
{name} AS MATERIALIZED (SELECT p.frame, p.y, p.x, coalesce(u.n, p.s) AS s FROM {source} p LEFT JOIN {name}u u ON u.frame = p.frame AND u.y = p.y AND u.x = p.x)"""


@query("h4_edge_filter", f"{WITH}, {_edge_sql('pixels', 'n', 4)} SELECT frame, y, x, CAST(CASE WHEN mask THEN greatest(-128, least(127, p0 - 128 + f2)) + 128 ELSE p0 END AS BIGINT) AS p0, CAST(CASE WHEN mask THEN greatest(-128, least(127, q0 - 128 - f1)) + 128 ELSE q0 END AS BIGINT) AS q0, CAST(CASE WHEN mask AND NOT hev THEN greatest(-128, least(127, p1 - 128 + ((f1 + 1) >> 1))) + 128 ELSE p1 END AS BIGINT) AS p1 FROM ng")
def edge_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The narrow filter across the vertical edges of blocks: a row of the block and one of its neighbour on the left have all it needs."""
    own = A.blocks(spark, folder)
    left = own.select("frame", "by", (F.col("bx") + 1).alias("bx"), F.col("v").alias("l"))
    both = own.join(left, ["frame", "by", "bx"]).select("frame", "by", "bx", "v", "l", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    taps = [F.get("l", F.col("i") * 8 + 6), F.get("l", F.col("i") * 8 + 7), F.get("v", F.col("i") * 8), F.get("v", F.col("i") * 8 + 1)]
    out = P.edge_filter(taps, *LIMITS[:3])
    return both.select("frame", (F.col("by") * 8 + F.col("i")).alias("y"), (F.col("bx") * 8).alias("x"), out["p0"].alias("p0"), out["q0"].alias("q0"), out["p1"].alias("p1"))


#: Samples with a quarter of their range, so that masks let filters through.
CALM = f"{WITH}, calm AS MATERIALIZED (SELECT frame, y, x, 96 + (s >> 2) AS s FROM pixels)"


def _calm(samples):
    return 96 + (samples >> 2)


def _edges_of(size: int) -> None:
    @query(f"h4_edge_filter{size}", f"{CALM}, {_edge_sql('calm', 'n', size)} {_DIGEST.format(t='n').replace('sum(o', 'sum(s')}")
    def wide_filter(spark: SparkSession, folder: str) -> DataFrame:
        """The filters of more samples, across all vertical edges."""
        return R.digests(A.blocks(spark, folder), lambda samples, there: R.edges(_calm(samples), there, size, *LIMITS))


for _size in (6, 8, 16):
    _edges_of(_size)


@query("h1_loop_filter", f"{CALM}, {_edge_sql('calm', 'n', 8)}, {_edge_sql('n', 'o', 8, 'y')} {_DIGEST.format(t='o').replace('sum(o', 'sum(s')}")
def loop_filter(spark: SparkSession, folder: str) -> DataFrame:
    """All vertical edges of a frame, then all horizontal ones of what that gave."""
    return R.digests(A.blocks(spark, folder), lambda samples, there: R.loop_filter(_calm(samples), there, 8, *LIMITS))


SIZES = {"a": (0, 3), "b": (3, 3), "skip": (6, 1)}


@query("h2_filter_size", f"{DIGESTS}, f AS (SELECT doc_id, 4 << ({_hex(0, 3)} % 5)::INT AS a, 4 << ({_hex(3, 3)} % 5)::INT AS b, {_hex(6, 1)} AS skip FROM digests) SELECT doc_id, a, b, CASE WHEN skip = 1 AND a = b THEN 0 ELSE least(16, least(a, b)) END AS size FROM f")
def filter_size(spark: SparkSession, folder: str) -> DataFrame:
    """Length of an edge's filter: the smaller transform, 16 at most; none inside skipped blocks."""
    data = F.col("data")
    size = lambda at: fx.shl(F.lit(4).cast("long"), bits.f(data, at, 3) % 5)
    own = A.digests(spark, folder).select("doc_id", size(0).alias("a"), size(3).alias("b"), bits.f(data, 6, 1).alias("skip"))
    none = (F.col("skip") == 1) & (F.col("a") == F.col("b"))
    return own.select("doc_id", "a", "b", F.when(none, F.lit(0).cast("long")).otherwise(F.least(F.lit(16).cast("long"), "a", "b")).alias("size"))


PRIMARY, SECONDARY, DAMPING = 12, 4, 5
OFFSETS = ", ".join(f"({d}, {s * dy}, {s * dx}, {(4 - 2 * step) if not turn else 2 - step}, {int(turn != 0)})" for d in range(8) for turn in (0, 2, -2) for step, (dy, dx) in enumerate(P.DIRECTIONS[(d + turn) % 8]) for s in (1, -1))


def _cdef_sql(source: str) -> str:
    """SQL of the filter of samples with d (direction) and pri (strength): ``r`` has frame, y, x, blk, s, o."""
    strength = f"CASE WHEN o.second = 1 THEN {SECONDARY} ELSE a.pri END"
    return f"""o AS (SELECT * FROM (VALUES {OFFSETS}) t(d, dy, dx, w, second)), q AS MATERIALIZED (SELECT a.frame, a.y, a.x, a.blk, a.s, a.y + o.dy AS ny, a.x + o.dx AS nx, CASE WHEN o.second = 0 AND a.pri % 2 = 1 THEN 3 ELSE o.w END AS w, {strength} AS st, greatest(0, {DAMPING} - (length(bin(CAST(greatest(1, {strength}) AS BIGINT))) - 1)) AS sh FROM {source} a JOIN o ON o.d = a.d),
t AS (SELECT q.frame, q.y, q.x, q.blk, q.s, b.s AS n, w, st, sh FROM q JOIN pixels b ON b.frame = q.frame AND b.y = q.ny AND b.x = q.nx),
c AS (SELECT frame, y, x, blk, s, CAST(sum(w * sign(n - s) * CASE WHEN st = 0 THEN 0 ELSE least(abs(n - s), greatest(0, st - (abs(n - s) >> CAST(sh AS INTEGER)))) END) AS BIGINT) AS t, min(least(n, s)) AS lo, max(greatest(n, s)) AS hi FROM t GROUP BY ALL),
r AS (SELECT frame, y, x, blk, s, greatest(lo, least(hi, s + ((8 + t - CASE WHEN t < 0 THEN 1 ELSE 0 END) >> 4))) AS o FROM c)"""


@query("h7_cdef_filter", f"{WITH}, a AS (SELECT frame, y, x, blk, s, blk % 8 AS d, {PRIMARY} AS pri FROM pixels), {_cdef_sql('a')} {_DIGEST.format(t='r')}")
def cdef_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Primary and secondary taps about a direction given for each block (its number modulo 8)."""
    own = A.blocks(spark, folder)

    def run(number):
        def one(samples, there):
            direction = (number + np.arange(samples.size // 64).reshape(samples.shape[0] // 8, samples.shape[1] // 8)) % 8
            return R.cdef(samples, there, direction, np.full_like(direction, PRIMARY), np.full_like(direction, SECONDARY), DAMPING)

        return one

    # the first block of a frame is 50 times its number: two modulo 8 a frame
    parts = [R.digests(own.where(F.col("frame") % 4 == k), run(50 * k)) for k in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_LINES = ", ".join(f"({d}, {p}, {B.line_of(d, *divmod(p, 8))})" for d in range(8) for p in range(64))


@query("h5_cdef_driver", f"""{WITH}, ln AS (SELECT * FROM (VALUES {_LINES}) t(d, p, line)), sums AS MATERIALIZED (SELECT blk, d, line, CAST(sum(s - 128) AS BIGINT) AS t, count(*) AS n FROM pixels JOIN ln USING (p) GROUP BY ALL),
cost AS MATERIALIZED (SELECT blk, d, CAST(sum(t * t * (840 // n)) AS BIGINT) AS cost FROM sums GROUP BY ALL), best AS (SELECT blk, arg_min(d, (-cost, d)) AS d, max(cost) AS best FROM cost GROUP BY blk),
way AS MATERIALIZED (SELECT b.blk, b.d, CASE WHEN (best - cost) >> 16 = 0 THEN 0 ELSE ({PRIMARY} * (4 + least(length(bin((best - cost) >> 16)) - 1, 12)) + 8) >> 4 END AS pri FROM best b JOIN cost c ON b.blk = c.blk AND c.d = (b.d + 4) % 8),
a AS MATERIALIZED (SELECT frame, y, x, blk, s, d, pri FROM pixels JOIN way USING (blk)), {_cdef_sql('a')}, k AS (SELECT frame, y, x, CASE WHEN blk % 50 % 4 = 3 THEN s ELSE o END AS o FROM r) {_DIGEST.format(t='k')}""")
def cdef_driver(spark: SparkSession, folder: str) -> DataFrame:
    """The filter along the directions that the blocks themselves have, weaker where they vary little; every fourth block is skipped."""
    return R.digests(A.blocks(spark, folder), lambda samples, there: R.directed(samples, there, PRIMARY, SECONDARY, DAMPING, lambda number: number % 4 == 3))


PHASES = [[0, 128, 0, 0], [-4, 116, 18, -2], [-8, 72, 72, -8], [-2, 18, 116, -4]]
_STEP = ((80 << 14) + 64) // 128


@query("h8_superres_upscale", f"{WITH}, w AS (SELECT * FROM (VALUES {', '.join(f'({p}, {k}, {t})' for p, row in enumerate(PHASES) for k, t in enumerate(row))}) t(phase, k, w)), a AS (SELECT CAST(range AS INTEGER) AS ox, range * {_STEP} + {_STEP // 2} - 8192 AS pos FROM range(128)), r AS (SELECT p.frame, p.y, a.ox AS x, greatest(0, least(255, (CAST(sum(w.w * p.s) AS BIGINT) + 64) >> 7)) AS o FROM a JOIN w ON w.phase = ((a.pos & 16383) * 4) >> 14 JOIN pixels p ON p.x = greatest(0, least(79, (a.pos >> 14) + w.k - 1)) GROUP BY p.frame, p.y, a.ox) {_DIGEST.format(t='r')}")
def superres_upscale(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of 80 samples resampled to 128 with four phases of four taps, given."""
    return R.digests(A.blocks(spark, folder), lambda samples, there: R.upscaled(samples, 128, PHASES))


@query("h9_restoration_units", f"{WITH} SELECT frame, (y + 8) // 16 AS stripe, x // 40 AS unit, count(*) AS n, CAST(sum(s) AS BIGINT) AS total FROM pixels GROUP BY ALL")
def restoration_units(spark: SparkSession, folder: str) -> DataFrame:
    """Samples dealt to stripes (offset by 8 rows) and units, the groups that restoration works on."""
    own = A.pixels(spark, folder)
    return own.groupBy("frame", F.expr("(y + 8) div 16").alias("stripe"), F.expr("x div 40").alias("unit")).agg(F.count("*").alias("n"), F.sum("s").alias("total"))


POINTS = ((16, 20), (80, 60), (160, 40), (235, 96))
_SEGMENTS = ", ".join(f"({a[0]}, {b[0]}, {a[1]}, {(b[1] - a[1]) * ((65536 + ((b[0] - a[0]) >> 1)) // (b[0] - a[0]))})" for a, b in zip(POINTS, POINTS[1:], strict=False))


@query("i4_scaling_lut", f"{WITH}, g AS (SELECT * FROM (VALUES {_SEGMENTS}) t(lo, hi, y0, d)) SELECT blk, CAST(sum(CASE WHEN s < {POINTS[0][0]} THEN {POINTS[0][1]} WHEN s >= {POINTS[-1][0]} THEN {POINTS[-1][1]} ELSE y0 + (((s - lo) * d + 32768) >> 16) END) AS BIGINT) AS total FROM pixels LEFT JOIN g ON s >= lo AND s < hi GROUP BY blk")
def scaling_lut(spark: SparkSession, folder: str) -> DataFrame:
    """Noise strength of every sample by a piecewise linear function of its value: a range join, made a lookup."""
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in POINTS])
    lut = F.array(*[F.lit(x).cast("long") for x in spark.range(1).select(B.scaling_lut(points).alias("lut")).first()["lut"]])  # 256 numbers
    own = A.blocks(spark, folder).withColumn("lut", lut)
    return own.select("blk", B.total(F.transform("v", lambda x: F.get("lut", x))).alias("total"))


@query("i6_add_noise", f"{WITH} SELECT blk, CAST(sum(greatest(16, least(235, s + ((40 * ((p * 37 + blk * 11) % 61 - 30) + 256) >> 9)))) AS BIGINT) AS total FROM pixels GROUP BY blk")
def add_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled noise added and clipped to the restricted range; the noise itself is given, a function of the place."""
    noise = lambda p: (p * 37 + F.col("blk") * 11) % 61 - 30
    out = F.transform("v", lambda s, p: fx.clip3(F.lit(16).cast("long"), F.lit(235).cast("long"), s + fx.shr(40 * noise(p) + 256, 9)))
    return A.blocks(spark, folder).select("blk", B.total(out).alias("total"))


@query("i3_grain_template")
def grain_template(spark: SparkSession, folder: str) -> DataFrame:
    """Auto-regressive template of each frame from a 16-bit register's noise."""
    return kernels.grain_templates(A.blocks(spark, folder).select("frame").distinct())


@query("i5_noise_stripes", f"{WITH}, s AS (SELECT frame, unnest(range(3)) AS stripe FROM (SELECT DISTINCT frame FROM pixels)) SELECT frame, stripe, xor((frame * 331 % 65536), ((((37 * stripe + 178) & 255) << 8) + ((173 * stripe + 105) & 255))) AS seed FROM s")
def noise_stripes(spark: SparkSession, folder: str) -> DataFrame:
    """Seed of each stripe of 32 rows: the frame's seed mixed with two functions of the stripe."""
    own = A.blocks(spark, folder).select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("stripe"))
    k = F.col("stripe")
    mixed = fx.shl(fx.band(37 * k + 178, 255), 8) + fx.band(173 * k + 105, 255)
    return own.select("frame", "stripe", (F.col("frame") * 331 % 65536).bitwiseXOR(mixed).alias("seed"))


SCALES = (0.0, 0.5, 0.75, 1.0, 1.25, 1.5)


@query("k18_filter_level_search", f"{WITH}, c AS (SELECT * FROM (VALUES {', '.join(f'({k}, {s}::DOUBLE)' for k, s in enumerate(SCALES))}) t(ord, scale)), r AS (SELECT a.frame, c.ord, least(63, CAST(floor(24 * c.scale + 0.5) AS BIGINT)) AS level, CAST(sum((a.s - b.s - least(63, CAST(floor(24 * c.scale + 0.5) AS BIGINT)) // 8) * (a.s - b.s - least(63, CAST(floor(24 * c.scale + 0.5) AS BIGINT)) // 8)) AS BIGINT) AS sse FROM pixels a JOIN pixels b ON b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x, c GROUP BY ALL) SELECT frame, arg_min(level, (sse, ord)) AS level, min(sse) AS sse FROM r GROUP BY frame")
def filter_level_search(spark: SparkSession, folder: str) -> DataFrame:
    """Of six scales of a level the one with the least error, the first on ties; a level's effect is a shift by an eighth of it."""
    own = A.pixels(spark, folder).select("frame", "y", "x", "s")
    past = own.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col("s").alias("r"))
    level = [min(63, int(24 * s + 0.5)) for s in SCALES]
    d = F.col("s") - F.col("r")
    sums = own.join(past, ["frame", "y", "x"]).groupBy("frame").agg(*[F.sum((d - v // 8) * (d - v // 8)).alias(f"e{k}") for k, v in enumerate(level)])
    best = F.array_min(F.array(*[F.struct(F.col(f"e{k}").alias("sse"), F.lit(k).alias("ord"), F.lit(v).cast("long").alias("level")) for k, v in enumerate(level)]))
    return sums.select("frame", best["level"].alias("level"), best["sse"].alias("sse"))


STRENGTHS = (0, 2, 4, 8, 12, 16)


def _choices(spark: SparkSession, folder: str) -> DataFrame:
    """frame, blk, k, sse: error of each block with each of a few strengths, as a clipped move towards the block before."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(STRENGTHS)])
    own = A.pairs(spark, folder).select("frame", "blk", "v", "ref", F.explode(each).alias("c"))
    error = F.aggregate(F.zip_with("v", "ref", lambda x, r: x - r - fx.clip3(-F.col("c.s"), F.col("c.s"), x - r)), F.lit(0).cast("long"), lambda t, e: t + e * e)
    return own.select("frame", "blk", F.col("c.k").alias("k"), (error + F.col("c.s") * 40).alias("sse"))


CHOICES = f"WITH {A.PAIRS}, st AS (SELECT * FROM (VALUES {', '.join(f'({k}, {s})' for k, s in enumerate(STRENGTHS))}) t(k, st)), ch AS (SELECT frame, blk, k, CAST(sum((s - r - greatest(-st, least(st, s - r))) * (s - r - greatest(-st, least(st, s - r)))) AS BIGINT) + any_value(st) * 40 AS sse FROM pairs, st GROUP BY frame, blk, k)"


@query("k19_cdef_sse_table", f"{CHOICES} SELECT frame, k, CAST(sum(sse) AS BIGINT) AS sse, count(*) AS blocks FROM ch GROUP BY ALL")
def cdef_sse_table(spark: SparkSession, folder: str) -> DataFrame:
    """Error of every candidate strength, a frame: what the greedy choice starts from."""
    return _choices(spark, folder).groupBy("frame", "k").agg(F.sum("sse").alias("sse"), F.count("*").alias("blocks"))


@query("k19_cdef_greedy", f"{CHOICES}, t AS (SELECT frame, k, sum(sse) AS e FROM ch GROUP BY ALL), one AS (SELECT frame, arg_min(k, (e, k)) AS a FROM t GROUP BY frame), two AS (SELECT c.frame, o.a, c.k, sum(least(c.sse, b.sse)) AS e FROM ch c JOIN one o ON o.frame = c.frame JOIN ch b ON b.blk = c.blk AND b.k = o.a GROUP BY ALL), best AS (SELECT frame, a, arg_min(k, (e, k)) AS b, min(e) AS e FROM two GROUP BY frame, a) SELECT frame, a AS first, b AS second, CAST(e AS BIGINT) AS sse FROM best")
def cdef_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Two steps of the greedy cover: the best strength for all blocks, then the one that helps most beside it."""
    blocks = _choices(spark, folder).groupBy("frame", "blk").agg(F.array_sort(F.collect_list(F.struct("k", "sse"))).alias("c"))  # one per strength
    table = blocks.select("frame", "blk", F.transform("c", lambda x: x["sse"]).alias("e"))
    n = len(STRENGTHS)
    pick = lambda cols: F.array_min(F.array(*[F.struct(F.col(c).alias("e"), F.lit(k).alias("k")) for k, c in enumerate(cols)]))
    first = table.groupBy("frame").agg(*[F.sum(F.get("e", F.lit(k))).alias(f"s{k}") for k in range(n)]).select("frame", pick([f"s{k}" for k in range(n)])["k"].alias("a"))
    both = table.join(first, "frame").groupBy("frame", "a").agg(*[F.sum(F.least(F.get("e", F.lit(k)), F.get("e", F.col("a")))).alias(f"s{k}") for k in range(n)])
    best = pick([f"s{k}" for k in range(n)])
    return both.select("frame", F.col("a").alias("first"), best["k"].alias("second"), best["e"].alias("sse"))


@query("k20_lr_search", f"WITH {A.PAIRS}, u AS (SELECT frame, blk % 10 // 5 AS unit, CAST(sum((s - r) * (s - r)) AS DOUBLE) AS none, CAST(sum((s - (3 * r + s + 2) // 4) * (s - (3 * r + s + 2) // 4)) AS DOUBLE) AS weak, CAST(sum((s - (r + s + 1) // 2) * (s - (r + s + 1) // 2)) AS DOUBLE) AS strong FROM pairs GROUP BY ALL) SELECT frame, unit, CASE WHEN none + 100.0 * 1 <= weak + 100.0 * 40 AND none + 100.0 * 1 <= strong + 100.0 * 20 THEN 'none' WHEN weak + 100.0 * 40 <= strong + 100.0 * 20 THEN 'weak' ELSE 'strong' END AS kind, least(none + 100.0, weak + 4000.0, strong + 2000.0) AS cost FROM u")
def lr_search(spark: SparkSession, folder: str) -> DataFrame:
    """Of no filter and two others the least error plus lambda times a fixed rate, a unit; first on ties."""
    error = lambda k, w: B.sse(F.col("v"), F.zip_with("ref", "v", lambda r, x: fx.idiv(w * r + x + fx.idiv(F.lit(k), 2), k).cast("int")))
    own = A.pairs(spark, folder).select("frame", F.expr("pmod(blk, 10) div 5").alias("unit"), B.sse(F.col("v"), F.col("ref")).alias("n"), error(4, 3).alias("w"), error(2, 1).alias("s"))
    sums = own.groupBy("frame", "unit").agg(*[F.sum(c).cast("double").alias(c) for c in "nws"])
    best = F.array_min(F.array(*[F.struct((F.col(c) + 100.0 * rate).alias("cost"), F.lit(k).alias("ord"), F.lit(name).alias("kind")) for k, (c, rate, name) in enumerate((("n", 1, "none"), ("w", 40, "weak"), ("s", 20, "strong")))]))
    return sums.select("frame", "unit", best["kind"].alias("kind"), best["cost"].alias("cost"))


MOMENTS = f"WITH {A.PAIRS}, m AS (SELECT frame, CAST(sum(r * r) AS DOUBLE) AS aa, CAST(sum(r) AS DOUBLE) AS ab, CAST(count(*) AS DOUBLE) AS bb, CAST(sum(s * r) AS DOUBLE) AS ay, CAST(sum(s) AS DOUBLE) AS yb FROM pairs GROUP BY frame)"


def _moments(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of products of prediction (a), one (b) and source (y), a frame."""
    v, r = F.col("v"), F.col("ref")
    dot = lambda x, y: B.total(F.zip_with(x, y, lambda a, b: a.cast("long") * b))
    own = A.pairs(spark, folder).select("frame", dot(r, r).alias("aa"), B.total(r).alias("ab"), F.lit(64).alias("bb"), dot(v, r).alias("ay"), B.total(v).alias("yb"))
    return own.groupBy("frame").agg(*[F.sum(c).cast("double").alias(c) for c in ("aa", "ab", "bb", "ay", "yb")])


@query("k22_fit_sgr", f"{MOMENTS} SELECT frame, round((ay * bb - yb * ab) / (aa * bb - ab * ab), 8) AS slope, round((aa * yb - ab * ay) / (aa * bb - ab * ab), 6) AS offset_ FROM m WHERE aa * bb - ab * ab <> 0")
def fit_sgr(spark: SparkSession, folder: str) -> DataFrame:
    """Two weights by least squares: moments are sums, the 2x2 equations are solved by determinants."""
    m = _moments(spark, folder)
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return m.where(det != 0).select("frame", F.round((F.col("ay") * F.col("bb") - F.col("yb") * F.col("ab")) / det, 8).alias("slope"), F.round((F.col("aa") * F.col("yb") - F.col("ab") * F.col("ay")) / det, 6).alias("offset_"))


@query("k21_fit_wiener")
def fit_wiener(spark: SparkSession, folder: str) -> DataFrame:
    """Symmetric taps of each frame by alternating least squares, against the frame before."""
    own = A.pixels(spark, folder).select("frame", "y", "x", "s")
    past = own.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col("s").alias("r"))
    return kernels.wiener_fits(own.join(past, ["frame", "y", "x"]))


@query("f15_warp_moments", f"WITH {A.PAIRS} SELECT blk, CAST(sum((i * 2 - 7) * (s - r)) AS BIGINT) AS my, CAST(sum((j * 2 - 7) * (s - r)) AS BIGINT) AS mx, CAST(sum((i * 2 - 7) * (i * 2 - 7)) AS BIGINT) AS yy, CAST(sum((i * 2 - 7) * (j * 2 - 7)) AS BIGINT) AS xy FROM pairs GROUP BY blk")
def warp_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Moments of the least-squares warp: sums of products of offsets and differences."""
    d = F.col("d")
    own = B.fixed(A.pairs(spark, folder), "blk", d=B.difference(F.col("v"), F.col("ref")))
    y, x = lambda p: fx.idiv(p, 8) * 2 - 7, lambda p: p % 8 * 2 - 7
    weigh = lambda f: B.total(F.transform(d, lambda e, p: f(p).cast("long") * e))
    square = lambda f: B.total(F.transform(d, lambda e, p: f(p).cast("long")))
    return own.select("blk", weigh(y).alias("my"), weigh(x).alias("mx"), square(lambda p: y(p) * y(p)).alias("yy"), square(lambda p: y(p) * x(p)).alias("xy"))
