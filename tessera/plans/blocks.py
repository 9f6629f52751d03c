"""Costs, transforms, prediction and searches over blocks (F, G, H6, I4, K, N)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from tessera.functions import adapters as A, fx
from tessera.operators import blocks as B, frames, kernels
from tessera.plans.registry import query

SAD = "CAST(sum(abs(a.s - b.s)) AS BIGINT)"
LAMBDA, BITS = 0.1 * 4.0 * 4.0, 3 * 256


def _candidates(spark: SparkSession, folder: str, reach: int = 4) -> DataFrame:
    """blk, v, back, ref: each block with the ones ``reach`` or less before it."""
    own = A.blocks(spark, folder).select("blk", "v")
    before = own.select(F.col("v").alias("ref"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("back"), "blk").select((F.col("blk") + F.col("back")).alias("blk"), "back", "ref")
    return own.join(before, "blk")


CANDIDATES = f"""WITH {A.PIXELS}, cand AS (SELECT a.blk, a.blk - b.blk AS back, {SAD} AS sad, CAST(sum((a.s - b.s) * (a.s - b.s)) AS BIGINT) AS sse
FROM pixels a JOIN (SELECT blk + k AS at, blk, p, s FROM pixels, (SELECT unnest(range(1, 5)) AS k)) b ON a.blk = b.at AND a.p = b.p GROUP BY a.blk, b.blk)"""


@query("k1_sad_best_match", f"{CANDIDATES} SELECT blk, arg_min(blk - back, (sad, back)) AS match, min(sad) AS sad FROM cand GROUP BY blk")
def sad_best_match(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of the four blocks before with the least sum of absolute differences."""
    cost = F.struct(B.sad(F.col("v"), F.col("ref")).alias("sad"), F.col("back"))
    best = _candidates(spark, folder).groupBy("blk").agg(F.min(cost).alias("best"))
    return best.select("blk", (F.col("blk") - F.col("best.back")).alias("match"), F.col("best.sad").alias("sad"))


@query("k2_sse", f"WITH {A.PAIRS} SELECT blk, CAST(sum((s - r) * (s - r)) AS BIGINT) AS sse FROM pairs GROUP BY blk")
def sse(spark: SparkSession, folder: str) -> DataFrame:
    return A.pairs(spark, folder).select("blk", B.sse(F.col("v"), F.col("ref")).alias("sse"))


def _hadamard_sql() -> str:
    rows = "(VALUES (0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 0, 1), (1, 1, 1), (1, 2, -1), (1, 3, -1), (2, 0, 1), (2, 1, -1), (2, 2, 1), (2, 3, -1), (3, 0, 1), (3, 1, -1), (3, 2, -1), (3, 3, 1)) AS h(k, n, w)"
    return f"hw AS (SELECT * FROM {rows}), coef AS (SELECT blk, i // 4 AS qy, j // 4 AS qx, a.k AS u, b.k AS w, sum((s - r) * a.w * b.w) AS c FROM pairs JOIN hw a ON i % 4 = a.n JOIN hw b ON j % 4 = b.n GROUP BY ALL)"


@query("k3_satd", f"WITH {A.PAIRS}, {_hadamard_sql()} SELECT blk, CAST(sum(abs(c)) // 2 AS BIGINT) AS satd FROM coef GROUP BY blk")
def satd(spark: SparkSession, folder: str) -> DataFrame:
    return B.fixed(A.pairs(spark, folder), "blk", d=B.difference(F.col("v"), F.col("ref"))).select("blk", B.satd(F.col("d")).alias("satd"))


@query("g14_hadamard4x4", f"WITH {A.PAIRS}, {_hadamard_sql()} SELECT blk, CAST(qy * 2 + qx AS INTEGER) AS quarter, CAST(sum(CASE WHEN u = 0 AND w = 0 THEN c ELSE 0 END) AS BIGINT) AS dc, CAST(sum(CASE WHEN u = 1 AND w = 2 THEN c ELSE 0 END) AS BIGINT) AS c12, CAST(max(abs(c)) AS BIGINT) AS largest, CAST(sum(abs(c)) AS BIGINT) AS size FROM coef GROUP BY blk, qy, qx")
def hadamard(spark: SparkSession, folder: str) -> DataFrame:
    own = B.fixed(A.pairs(spark, folder), "blk", d=B.difference(F.col("v"), F.col("ref")))
    part = lambda y, x: F.array(*[B.at(F.col("d"), y + i, x + j) for i in range(4) for j in range(4)])
    quarters = F.array(*[F.struct(F.lit(y // 4 * 2 + x // 4).alias("quarter"), part(y, x).alias("d")) for y in (0, 4) for x in (0, 4)])
    own = own.select("blk", F.explode(quarters).alias("q"))
    c = B.hadamard4([F.col("q.d")[k] for k in range(16)])
    size = sum((F.abs(x) for x in c[1:]), F.abs(c[0]))
    return own.select("blk", "q.quarter", c[0].cast("long").alias("dc"), c[6].cast("long").alias("c12"), F.greatest(*[F.abs(x) for x in c]).cast("long").alias("largest"), size.cast("long").alias("size"))


@query("k4_rd_cost", f"{CANDIDATES}, cost AS (SELECT blk, back, sse + {LAMBDA} * (back * {BITS}) / 256.0 AS cost FROM cand) SELECT blk, arg_min(back, (cost, back)) AS back, round(min(cost), 6) AS cost FROM cost GROUP BY blk")
def rd_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Least squared error plus lambda times bits; lambda follows from a step of 32."""
    cost = B.sse(F.col("v"), F.col("ref")) + LAMBDA * (F.col("back") * BITS) / 256.0
    best = _candidates(spark, folder).groupBy("blk").agg(F.min(F.struct(cost.alias("cost"), F.col("back").cast("long").alias("back"))).alias("best"))
    return best.select("blk", "best.back", F.round("best.cost", 6).alias("cost"))


@query(
    "k5_partition_search",
    f"""WITH {A.PAIRS}, own AS (SELECT blk, frame, (blk % 50) // 10 // 2 AS py, blk % 10 // 2 AS px, sum((s - r) * (s - r)) AS sse FROM pairs GROUP BY ALL),
parent AS (SELECT frame, py, px, CAST(sum(sse) AS BIGINT) AS split_sse, count(*) AS parts, CAST(max(sse) * count(*) AS BIGINT) AS whole_sse FROM own GROUP BY ALL)
SELECT frame, py, px, parts, split_sse + {LAMBDA} * (parts * {BITS} + 512) / 256.0 AS split_cost, whole_sse + {LAMBDA} * {BITS} / 256.0 AS whole_cost,
CASE WHEN split_sse + {LAMBDA} * (parts * {BITS} + 512) / 256.0 < whole_sse + {LAMBDA} * {BITS} / 256.0 THEN 'split' ELSE 'none' END AS partition FROM parent""",
)
def partition_search(spark: SparkSession, folder: str) -> DataFrame:
    """One level of the bottom-up tree: the cost of a square's parts against its cost as a whole (its worst part throughout)."""
    own = A.pairs(spark, folder).select("frame", F.expr("pmod(blk, 50) div 10 div 2").alias("py"), F.expr("pmod(blk, 10) div 2").alias("px"), B.sse(F.col("v"), F.col("ref")).alias("sse"))
    parent = own.groupBy("frame", "py", "px").agg(F.count("*").alias("parts"), F.sum("sse").alias("s"), F.max("sse").alias("m"))
    split = F.col("s") + LAMBDA * (F.col("parts") * BITS + 512) / 256.0
    whole = F.col("m") * F.col("parts") + LAMBDA * BITS / 256.0
    return parent.select("frame", "py", "px", "parts", split.alias("split_cost"), whole.alias("whole_cost"), F.when(split < whole, "split").otherwise("none").alias("partition"))


@query(
    "k6_partition_greedy",
    f"""WITH {A.PIXELS}, var AS (SELECT blk, sum(s * s) / 64.0 - (sum(s) / 64.0) * (sum(s) / 64.0) AS whole FROM pixels GROUP BY blk),
quad AS (SELECT blk, p // 32 AS a, p % 8 // 4 AS b, sum(s * s) / 16.0 - (sum(s) / 16.0) * (sum(s) / 16.0) AS v FROM pixels GROUP BY ALL),
m AS (SELECT blk, sum(v) / 4.0 AS quads FROM quad GROUP BY blk)
SELECT blk, round(whole, 6) AS whole, round(quads, 6) AS quads, whole > 0.6 * 900.0 AND (quads < whole * 0.75 OR whole > 4.0 * 900.0) AS split FROM var JOIN m USING (blk)""",
)
def partition_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Split where the variance is above what a step of 30 keeps and the quarters vary less, or it is far above."""
    quads = sum((B.variance(F.col("v"), y, x, 4) for y in (0, 4) for x in (0, 4)), F.lit(0.0)) / 4.0
    own = A.blocks(spark, folder).select("blk", B.variance(F.col("v")).alias("w"), quads.alias("q"))
    split = (F.col("w") > 0.6 * 900.0) & ((F.col("q") < F.col("w") * 0.75) | (F.col("w") > 4.0 * 900.0))
    return own.select("blk", F.round("w", 6).alias("whole"), F.round("q", 6).alias("quads"), split.alias("split"))


@query("k7_block_decision", f"{CANDIDATES}, all_c AS (SELECT blk, 'match' || back AS kind, back AS ord, sad + 8 * back AS cost FROM cand UNION ALL SELECT blk, 'flat', 0, CAST(sum(abs(s - m)) AS BIGINT) + 40 FROM (SELECT blk, s, (sum(s) OVER (PARTITION BY blk) + 32) // 64 AS m FROM pixels) GROUP BY blk) SELECT blk, arg_min(kind, (cost, ord)) AS kind, CAST(min(cost) AS BIGINT) AS cost FROM all_c GROUP BY blk")
def block_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Union of candidates of several kinds, argmin with ties to the first."""
    match = _candidates(spark, folder).select("blk", F.concat(F.lit("match"), F.col("back")).alias("kind"), F.col("back").alias("ord"), (B.sad(F.col("v"), F.col("ref")) + 8 * F.col("back")).alias("cost"))
    mean = F.col("mean")
    flat = B.fixed(A.blocks(spark, folder), "blk", v=F.col("v"), mean=fx.idiv(B.total(F.col("v")) + 32, 64)).select("blk", F.lit("flat").alias("kind"), F.lit(0).alias("ord"), (B.total(F.transform("v", lambda x: F.abs(x - mean))) + 40).alias("cost"))
    best = match.unionByName(flat).groupBy("blk").agg(F.min(F.struct("cost", "ord", "kind")).alias("best"))
    return best.select("blk", "best.kind", "best.cost")


@query("k8_preselection", f"{CANDIDATES} SELECT blk, back, sad, rank FROM (SELECT blk, back, sad, row_number() OVER (PARTITION BY blk ORDER BY sad, back) AS rank FROM cand) WHERE rank <= 2")
def preselection(spark: SparkSession, folder: str) -> DataFrame:
    """The two best candidates by the cheap cost, for the dear one."""
    cost = _candidates(spark, folder).select("blk", F.col("back").cast("long").alias("back"), B.sad(F.col("v"), F.col("ref")).alias("sad"))
    return cost.withColumn("rank", F.row_number().over(Window.partitionBy("blk").orderBy("sad", "back"))).where("rank <= 2")


REACH = 2


@query(
    "k9_motion_full",
    f"""WITH {A.PIXELS.replace("pixels AS (", "pixels AS MATERIALIZED (")}, asked AS MATERIALIZED (SELECT blk, frame - 1 AS frame, greatest(0, least(39, y + dy)) AS y, greatest(0, least(79, x + dx)) AS x, s, dy, dx FROM pixels, (SELECT unnest(range(-{REACH}, {REACH + 1})) AS dy), (SELECT unnest(range(-{REACH}, {REACH + 1})) AS dx)),
cand AS (SELECT a.blk, dy, dx, CAST(sum(abs(a.s - r.s)) AS BIGINT) AS sad FROM asked a JOIN pixels r ON r.frame = a.frame AND r.y = a.y AND r.x = a.x GROUP BY ALL)
SELECT blk, arg_min(dy, (sad + 4 * (abs(dy) + abs(dx)), dy, dx)) AS dy, arg_min(dx, (sad + 4 * (abs(dy) + abs(dx)), dy, dx)) AS dx, min(sad + 4 * (abs(dy) + abs(dx))) AS cost FROM cand GROUP BY blk""",
)
def motion_full(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-sample motion search in the frame before: blocks meet by frame, and each vector is a shift of the plane before."""
    found = frames.with_past(A.blocks(spark, folder), lambda now, past, there: frames.motion(now, past, REACH, 4, there), ["dy", "dx", "cost"])
    return found.where("cost >= 0")  # what reaches a sample of that frame


_BITS = "CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + 2.0::DOUBLE * (e + CAST(abs(d) + 2 - (1 << e) AS DOUBLE) / CAST(1 << e AS DOUBLE)) END"


@query("k11_mv_bits", f"WITH {A.PIXELS}, d AS (SELECT a.blk, a.s - b.s AS d, CAST(length(bin(CAST(abs(a.s - b.s) + 2 AS BIGINT))) - 1 AS INTEGER) AS e FROM pixels a JOIN pixels b ON b.blk = a.blk AND b.p = a.p + 1 WHERE a.p % 2 = 0) SELECT blk, round(sum({_BITS}), 6) AS bits, round(max({_BITS}), 6) AS most FROM d GROUP BY blk")
def mv_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Bits of vectors whose components are the differences of neighbouring samples, two by two."""
    each = F.transform(F.sequence(F.lit(0), F.lit(62), F.lit(2)), lambda p: fx.mv_bits(F.get("v", p) - F.get("v", p + 1)))
    own = A.blocks(spark, folder).select("blk", each.alias("b"))
    return own.select("blk", F.round(F.aggregate("b", F.lit(0.0), lambda s, x: s + x), 6).alias("bits"), F.round(F.array_max("b"), 6).alias("most"))


@query("k12_compound_satd", f"""WITH {A.PIXELS}, pairs AS (SELECT a.blk, a.p // 8 AS i, a.p % 8 AS j, a.s, (b.s + c.s + 1) >> 1 AS r FROM pixels a JOIN pixels b ON a.blk = b.blk + 1 AND a.p = b.p JOIN pixels c ON a.blk = c.blk + 2 AND a.p = c.p), {_hadamard_sql()} SELECT blk, CAST(sum(abs(c)) // 2 AS BIGINT) AS satd FROM coef GROUP BY blk""")
def compound_satd(spark: SparkSession, folder: str) -> DataFrame:
    """Transformed difference to the average of the two blocks before."""
    own = A.blocks(spark, folder).select("blk", "v")
    ref = lambda k: own.select((F.col("blk") + k).alias("blk"), F.col("v").alias(f"r{k}"))
    both = own.join(ref(1), "blk").join(ref(2), "blk")
    return B.fixed(both, "blk", d=B.difference(F.col("v"), B.compound_average(F.col("r1"), F.col("r2")))).select("blk", B.satd(F.col("d")).alias("satd"))


@query("k14_palette_colours", f"WITH {A.PIXELS}, c AS (SELECT blk, list_sort(list(DISTINCT s)) AS d FROM pixels GROUP BY blk) SELECT blk, len(d) AS n, CASE WHEN len(d) >= 2 AND d[-1] - d[1] >= 48 THEN true ELSE false END AS usable, CASE WHEN len(d) BETWEEN 2 AND 8 AND d[-1] - d[1] >= 48 THEN d[1] END AS first FROM c")
def palette_colours(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct colours and whether a palette is worth it; k-means of larger blocks has tests of its own."""
    own = A.blocks(spark, folder).select("blk", F.array_sort(F.array_distinct("v")).alias("d"))
    usable = (F.size("d") >= 2) & (F.element_at("d", -1) - F.col("d")[0] >= 48)
    return own.select("blk", F.size("d").cast("long").alias("n"), usable.alias("usable"), F.when(usable & (F.size("d") <= 8), F.col("d")[0]).alias("first"))


@query("k14_palette_kmeans")
def palette_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """Palettes of all blocks, by k-means where a block has more than eight colours."""
    return kernels.palettes(A.blocks(spark, folder).select("blk", "v"))


@query("k15_palette_map", f"WITH {A.PIXELS}, c AS (SELECT * FROM (VALUES (0, 96), (1, 120), (2, 136), (3, 170)) t(k, c)), m AS (SELECT blk, p, arg_min(k, (abs(s - c), k)) AS k FROM pixels, c GROUP BY blk, p) SELECT blk, CAST(sum(k * (p + 1)) AS BIGINT) AS checksum, CAST(sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM m GROUP BY blk")
def palette_map(spark: SparkSession, folder: str) -> DataFrame:
    places = B.palette_map(F.col("v"), F.array(*[F.lit(c) for c in (96, 120, 136, 170)]))
    own = A.blocks(spark, folder).select("blk", places.alias("m"))
    return own.select("blk", B.total(F.transform("m", lambda k, p: k * (p + 1))).alias("checksum"), B.total(F.transform("m", lambda k: F.when(k == 0, 1).otherwise(0))).alias("zeros"))


@query("f8_palette_predict", f"WITH {A.PIXELS}, c AS (SELECT * FROM (VALUES (0, 96), (1, 120), (2, 136), (3, 170)) t(k, c)), m AS (SELECT blk, p, arg_min(c, (abs(s - c), k)) AS c FROM pixels, c GROUP BY blk, p) SELECT blk, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c * p) AS BIGINT) AS weighted FROM m GROUP BY blk")
def palette_predict(spark: SparkSession, folder: str) -> DataFrame:
    colours = F.array(*[F.lit(c) for c in (96, 120, 136, 170)])
    own = A.blocks(spark, folder).select("blk", F.transform(B.palette_map(F.col("v"), colours), lambda k: F.element_at(colours, k + 1)).alias("m"))
    return own.select("blk", B.total(F.col("m")).alias("total"), B.total(F.transform("m", lambda c, p: c * p)).alias("weighted"))


@query("k16_cfl_alpha", f"WITH {A.PAIRS}, m AS (SELECT blk, CAST(sum(s * 8) AS BIGINT) // 64 AS lm, CAST(sum(r) AS BIGINT) // 64 AS cm FROM pairs GROUP BY blk), f AS (SELECT blk, CAST(sum((r - cm) * (s * 8 - lm)) AS BIGINT) AS num, CAST(sum((s * 8 - lm) * (s * 8 - lm)) AS BIGINT) AS den FROM pairs JOIN m USING (blk) GROUP BY blk) SELECT blk, CASE WHEN den <> 0 THEN CAST(greatest(-16.0, least(16.0, sign(num) * floor(abs(CAST(64 * num AS DOUBLE) / den) + 0.5))) AS INTEGER) END AS alpha FROM f")
def cfl_alpha(spark: SparkSession, folder: str) -> DataFrame:
    return B.cfl_alpha(A.pairs(spark, folder), "blk", F.col("v"), F.col("ref"))


@query("f9_chroma_from_luma", f"WITH {A.PAIRS}, m AS (SELECT blk, (CAST(sum(s * 8) AS BIGINT) + 32) >> 6 AS lm, (CAST(sum(r) AS BIGINT) + 32) >> 6 AS dc FROM pairs GROUP BY blk), o AS (SELECT blk, p, greatest(0, least(255, dc + CASE WHEN 5 * (s * 8 - lm) >= 0 THEN (5 * (s * 8 - lm) + 32) >> 6 ELSE -((-5 * (s * 8 - lm) + 32) >> 6) END)) AS c FROM pairs JOIN m USING (blk)) SELECT blk, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c * p) AS BIGINT) AS weighted FROM o GROUP BY blk")
def chroma_from_luma(spark: SparkSession, folder: str) -> DataFrame:
    own = B.fixed(A.pairs(spark, folder), "blk", v=F.col("v"), dc=fx.round2(B.total(F.col("ref")), 6), mean=fx.round2(B.total(F.col("v")) * 8, 6))
    own = own.select("blk", B.chroma_from_luma(F.col("dc"), F.col("v"), F.col("mean"), F.lit(5).cast("long")).alias("c"))
    return own.select("blk", B.total(F.col("c")).alias("total"), B.total(F.transform("c", lambda c, p: c * p)).alias("weighted"))


@query("k17_screen_content", f"""WITH {A.PIXELS}, b AS (SELECT frame, y // 16 AS by2, x // 16 AS bx2, count(DISTINCT s) AS n, max(s) - min(s) AS r FROM pixels WHERE y // 16 % 2 = 0 AND x // 16 % 2 = 0 AND y // 16 * 16 + 16 <= 40 GROUP BY ALL)
SELECT frame, count(*) AS blocks, CAST(count(*) FILTER (n <= 8 AND r >= 48) AS BIGINT) AS screen, count(*) FILTER (n <= 8 AND r >= 48) * 10 >= count(*) AS is_screen FROM b GROUP BY frame""")
def screen_content(spark: SparkSession, folder: str) -> DataFrame:
    """A frame whose 16x16 blocks, every other one each way, have few values and sharp edges."""
    own = A.pixels(spark, folder).withColumn("r2", F.expr("y div 16")).withColumn("c2", F.expr("x div 16"))
    sampled = own.where("r2 % 2 = 0 and c2 % 2 = 0 and r2 * 16 + 16 <= 40")
    each = sampled.groupBy("frame", "r2", "c2").agg(F.countDistinct("s").alias("n"), (F.max("s") - F.min("s")).alias("r"))
    screen = F.count(F.when((F.col("n") <= 8) & (F.col("r") >= 48), 1))
    return each.groupBy("frame").agg(F.count("*").alias("blocks"), screen.alias("screen")).withColumn("is_screen", F.col("screen") * 10 >= F.col("blocks"))


TYPES = ((0, "identity", 1.0), (1, "half", 2.0), (2, "double", 0.5))


@query("k13_tx_type_search", f"WITH {A.PAIRS}, t AS (SELECT * FROM (VALUES (0, 'identity', 1.0::DOUBLE), (1, 'half', 2.0::DOUBLE), (2, 'double', 0.5::DOUBLE)) t(ord, kind, step)), l AS (SELECT blk, ord, kind, s - r AS d, step, floor(abs(s - r) / (16.0::DOUBLE * step) + 0.38) AS level FROM pairs, t), c AS (SELECT blk, ord, kind, sum((abs(d) - level * 16.0 * step) * (abs(d) - level * 16.0 * step)) + {LAMBDA} * sum(CASE WHEN level > 0 THEN 2.0 + 2.0 * floor(log2(level + 1)) ELSE 0.0 END) AS cost FROM l GROUP BY ALL) SELECT blk, arg_min(kind, (round(cost, 6), ord)) AS kind, min(round(cost, 6)) AS cost FROM c GROUP BY blk")
def tx_type_search(spark: SparkSession, folder: str) -> DataFrame:
    """Trial cost of each type of a list: squared error plus lambda times bits of about 2 + 2 log2(level + 1)."""
    kinds = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), F.lit(s).alias("step")) for o, k, s in TYPES])
    own = A.pairs(spark, folder).select("blk", B.difference(F.col("v"), F.col("ref")).alias("d"), F.explode(kinds).alias("t"))
    q = 16.0 * F.col("t.step")
    level = lambda x: F.floor(F.abs(x) / q + 0.38)
    bits = lambda x: F.when(level(x) > 0, 2.0 + 2.0 * (F.length(F.bin(level(x) + 1)) - 1)).otherwise(0.0)
    error = lambda x: (F.abs(x) - level(x) * q) * (F.abs(x) - level(x) * q)
    cost = F.aggregate("d", F.lit(0.0), lambda s, x: s + error(x) + LAMBDA * bits(x))
    best = own.select("blk", F.struct(F.round(cost, 6).alias("cost"), "t.ord", "t.kind").alias("c")).groupBy("blk").agg(F.min("c").alias("b"))
    return best.select("blk", "b.kind", "b.cost")


_BASIS = ", ".join(f"({k}, {i}, {x!r}::DOUBLE)" for k, row in enumerate(B.basis()) for i, x in enumerate(row))
FORWARD = f"WITH {A.PAIRS}, bas AS (SELECT * FROM (VALUES {_BASIS}) t(k, n, w)), rowt AS (SELECT blk, i, k, sum((s - r) * w) AS c FROM pairs JOIN bas ON j = n GROUP BY ALL), fwd AS (SELECT blk, b.k AS u, a.k AS w, sum(c * b.w) AS c FROM rowt a JOIN bas b ON a.i = b.n GROUP BY ALL)"


def _forward(spark: SparkSession, folder: str) -> DataFrame:
    d = F.transform(B.difference(F.col("v"), F.col("ref")), lambda x: x.cast("double"))
    return B.transform_2d(A.pairs(spark, folder), "blk", d, B.basis())


@query("g12_forward_2d", f"{FORWARD} SELECT blk, round(max(CASE WHEN u = 0 AND w = 0 THEN c END), 4) + 0.0 AS dc, round(max(CASE WHEN u = 1 AND w = 2 THEN c END), 4) + 0.0 AS c12, round(sum(c * c), 3) AS energy FROM fwd GROUP BY blk")
def forward_2d(spark: SparkSession, folder: str) -> DataFrame:
    return _forward(spark, folder).select("blk", (F.round(F.col("c")[0], 4) + 0.0).alias("dc"), (F.round(F.col("c")[10], 4) + 0.0).alias("c12"), F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x), 3).alias("energy"))


LEVELS = f"{FORWARD}, lev AS (SELECT blk, u * 8 + w AS p, CAST(CASE WHEN c < 0 THEN -1 ELSE 1 END * least(floor(round(abs(c), 6) / CASE WHEN u = 0 AND w = 0 THEN 20.0 ELSE 28.0 END + CASE WHEN u = 0 AND w = 0 THEN 0.5 ELSE 0.38 END), 1048575) AS BIGINT) AS l FROM fwd)"


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    exact = F.transform("c", lambda x: F.when(x < 0, -F.round(-x, 6)).otherwise(F.round(x, 6)))
    own = B.fixed(_forward(spark, folder), "blk", c=exact)
    return B.fixed(own, "blk", l=B.quantise(F.col("c"), 20.0, 28.0))


@query("g13_quantise", f"{LEVELS} SELECT blk, CAST(sum(abs(l)) AS BIGINT) AS size, CAST(sum(l * (p + 1)) AS BIGINT) AS checksum, CAST(sum(CASE WHEN l <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzero FROM lev GROUP BY blk")
def quantise(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).select("blk", B.total(F.transform("l", lambda x: F.abs(x))).alias("size"), B.total(F.transform("l", lambda x, p: x * (p + 1))).alias("checksum"), B.total(F.transform("l", lambda x: F.when(x != 0, 1).otherwise(0))).alias("nonzero"))


@query("g5_end_of_block", f"{LEVELS} SELECT blk, CAST(coalesce(max(CASE WHEN l <> 0 THEN place + 1 END), 0) AS INTEGER) AS eob FROM lev JOIN (SELECT p, row_number() OVER (ORDER BY p // 8 + p % 8, p // 8) - 1 AS place FROM (SELECT unnest(range(64)) AS p)) USING (p) GROUP BY blk")
def end_of_block(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).select("blk", B.end_of_block(F.col("l"), B.diagonal_scan()).cast("int").alias("eob"))


@query("g6_dequantise", f"{LEVELS}, dq AS (SELECT blk, p, greatest(-32768, least(32767, CASE WHEN l < 0 THEN -1 ELSE 1 END * ((abs(l) * CASE WHEN p = 0 THEN 20 ELSE 28 END) & 16777215))) AS c FROM lev) SELECT blk, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c * (p + 1)) AS BIGINT) AS checksum FROM dq GROUP BY blk")
def dequantise(spark: SparkSession, folder: str) -> DataFrame:
    own = _levels(spark, folder).select("blk", B.dequantise(F.col("l"), 20, 28).alias("c"))
    return own.select("blk", B.total(F.col("c")).alias("total"), B.total(F.transform("c", lambda x, p: x * (p + 1))).alias("checksum"))


@query("g7_inverse_dct", f"{FORWARD}, rowi AS (SELECT blk, u, n AS j, sum(c * b.w) AS c FROM fwd a JOIN bas b ON a.w = b.k GROUP BY ALL), inv AS (SELECT blk, n AS i, j, sum(c * w) AS x FROM rowi JOIN bas ON u = k GROUP BY ALL) SELECT blk, round(sum(abs(x)), 3) AS size, CAST(max(abs(x - floor(x + 0.5))) < 1e-6 AS BOOLEAN) AS whole FROM inv GROUP BY blk")
def inverse_dct(spark: SparkSession, folder: str) -> DataFrame:
    """Forward and back again: the residual, whole to rounding."""
    turned = [list(row) for row in zip(*B.basis(), strict=True)]
    own = B.transform_2d(_forward(spark, folder), "blk", F.col("c"), turned, "x")
    return own.select("blk", F.round(F.aggregate("x", F.lit(0.0), lambda s, e: s + F.abs(e)), 3).alias("size"), (F.array_max(F.transform("x", lambda e: F.abs(e - F.floor(e + 0.5)))) < 1e-6).alias("whole"))


@query("g9_inverse_identity", f"WITH {A.PAIRS} SELECT blk, CAST(sum(((s - r) * 5793 + 2048) >> 12) AS BIGINT) AS n4, CAST(sum((s - r) * 2) AS BIGINT) AS n8, CAST(sum(((s - r) * 11586 + 2048) >> 12) AS BIGINT) AS n16, CAST(sum((s - r) * 4) AS BIGINT) AS n32 FROM pairs GROUP BY blk")
def inverse_identity(spark: SparkSession, folder: str) -> DataFrame:
    own = B.fixed(A.pairs(spark, folder), "blk", d=B.difference(F.col("v"), F.col("ref")))
    return own.select("blk", *[B.total(B.inverse_identity(F.col("d"), n)).alias(f"n{1 << n}") for n in (2, 3, 4, 5)])


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """blk, v, above, left, corner: the samples next to each block in its frame; null at the frame's edge."""
    own = A.blocks(spark, folder)
    row = lambda v, k: F.slice(v, F.lit(8 * k + 1), F.lit(8))
    above = own.select("frame", (F.col("by") + 1).alias("by"), "bx", row("v", 7).alias("above"))
    left = own.select("frame", "by", (F.col("bx") + 1).alias("bx"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("v")[i * 8 + 7]).alias("left"))
    corner = own.select("frame", (F.col("by") + 1).alias("by"), (F.col("bx") + 1).alias("bx"), F.col("v")[63].alias("corner"))
    at = ["frame", "by", "bx"]
    return own.join(above, at, "left").join(left, at, "left").join(corner, at, "left")


EDGES = f"""WITH {A.PIXELS}, above AS (SELECT frame, "by" + 1 AS "by", bx, p % 8 AS k, s FROM pixels WHERE p // 8 = 7), left_ AS (SELECT frame, "by", bx + 1 AS bx, p // 8 AS k, s FROM pixels WHERE p % 8 = 7), corner AS (SELECT frame, "by" + 1 AS "by", bx + 1 AS bx, s FROM pixels WHERE p = 63)"""


@query("f2_edges", f"""{EDGES} SELECT b.blk, CAST(coalesce((SELECT sum(s) FROM above a WHERE a.frame = b.frame AND a."by" = b."by" AND a.bx = b.bx), CASE WHEN b.bx > 0 THEN 8 * (SELECT s FROM left_ l WHERE l.frame = b.frame AND l."by" = b."by" AND l.bx = b.bx AND k = 0) ELSE 8 * 127 END) AS BIGINT) AS above_sum,
CAST(coalesce((SELECT sum(s) FROM left_ l WHERE l.frame = b.frame AND l."by" = b."by" AND l.bx = b.bx), CASE WHEN b."by" > 0 THEN 8 * (SELECT s FROM above a WHERE a.frame = b.frame AND a."by" = b."by" AND a.bx = b.bx AND k = 0) ELSE 8 * 129 END) AS BIGINT) AS left_sum FROM blocks b""")
def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with their fallbacks: the other edge's first sample, or one below and one above the middle."""
    own = _edges(spark, folder)
    fill = lambda x: F.array_repeat(x, 8)
    above = F.coalesce("above", F.when(F.col("left").isNotNull(), fill(F.col("left")[0])), fill(F.lit(127)))
    left = F.coalesce("left", F.when(F.col("above").isNotNull(), fill(F.col("above")[0])), fill(F.lit(129)))
    return own.select("blk", B.total(above).alias("above_sum"), B.total(left).alias("left_sum"))


@query("f3_intra_dc", f"""{EDGES}, e AS (SELECT * FROM above UNION ALL SELECT * FROM left_), n AS (SELECT frame, "by", bx, sum(s) AS s, count(*) AS n FROM e GROUP BY ALL) SELECT blk, CAST(CASE WHEN n IS NULL THEN 128 ELSE (s + n // 2) // n END AS BIGINT) AS dc FROM blocks LEFT JOIN n USING (frame, "by", bx)""")
def intra_dc(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).select("blk", B.dc_prediction(F.col("above"), F.col("left")).alias("dc"))


@query("f4_intra_v_h", f"""{EDGES} SELECT p.blk, CAST(sum(abs(p.s - a.s)) AS BIGINT) AS vertical, CAST(sum(abs(p.s - l.s)) AS BIGINT) AS horizontal FROM pixels p JOIN above a ON p.frame = a.frame AND p."by" = a."by" AND p.bx = a.bx AND a.k = p.p % 8 JOIN left_ l ON p.frame = l.frame AND p."by" = l."by" AND p.bx = l.bx AND l.k = p.p // 8 GROUP BY p.blk""")
def intra_v_h(spark: SparkSession, folder: str) -> DataFrame:
    """Absolute error of the two directions along the axes."""
    own = _edges(spark, folder).where("above is not null and left is not null")
    across = F.flatten(F.array_repeat(F.col("above"), 8))
    down = F.flatten(F.transform("left", lambda s: F.array_repeat(s, 8)))
    return own.select("blk", B.sad(F.col("v"), across).alias("vertical"), B.sad(F.col("v"), down).alias("horizontal"))


ANGLES = [base + 3 * step for base in (45, 67, 90, 113, 135, 157, 180, 203) for step in range(-3, 4)]


def _slope(angle: int) -> int:
    """Steps of a 64th of a sample along an edge, a row or column on: from the angle's tangent, in place of the format's table."""
    return math.floor(64 / math.tan(math.radians(angle)) + 0.5) if angle % 90 else 0


_SLOPES = ", ".join(f"({a}, {_slope(a) if a < 90 else _slope(180 - a) if a < 180 else 0}, {_slope(a - 90) if 90 < a < 180 else _slope(270 - a) if a > 180 else 0})" for a in ANGLES)
#: Lists that begin with the corner: the samples above and above to the right, those on the left and the last of them again.
_LONG_EDGES = f"""al AS (SELECT frame, "by", bx, list(s ORDER BY k) AS v FROM above GROUP BY ALL), ll AS (SELECT frame, "by", bx, list(s ORDER BY k) AS v FROM left_ GROUP BY ALL),
e AS (SELECT b.blk, list_concat([c.s], list_concat(a.v, coalesce(r.v, list_transform(range(8), lambda k: a.v[8])))) AS a, list_concat([c.s], list_concat(l.v, list_transform(range(8), lambda k: l.v[8]))) AS l FROM blocks b JOIN corner c ON c.frame = b.frame AND c."by" = b."by" AND c.bx = b.bx JOIN al a ON a.frame = b.frame AND a."by" = b."by" AND a.bx = b.bx JOIN ll l ON l.frame = b.frame AND l."by" = b."by" AND l.bx = b.bx LEFT JOIN al r ON r.frame = b.frame AND r."by" = b."by" AND r.bx = b.bx + 1)"""


def _between(edge: str, at: str) -> str:
    """SQL of the sample at a 64th of a place of a list, in 32nds."""
    base, part = f"({at}) >> 6", f"((({at}) >> 1) & 31)"
    return f"({edge}[({base}) + 2] * (32 - {part}) + {edge}[({base}) + 3] * {part} + 16) >> 5"


_DIRECTED = f"""CASE WHEN angle = 90 THEN a[j + 2] WHEN angle = 180 THEN l[i + 2]
WHEN angle < 90 THEN CASE WHEN (((i + 1) * dx) >> 6) + j < 15 THEN {_between('a', '(i + 1) * dx + j * 64')} ELSE a[17] END
WHEN angle > 180 THEN CASE WHEN (((j + 1) * dy) >> 6) + i < 15 THEN {_between('l', '(j + 1) * dy + i * 64')} ELSE l[17] END
WHEN (j * 64 - (i + 1) * dx) >> 6 >= -1 THEN {_between('a', 'j * 64 - (i + 1) * dx')} ELSE {_between('l', 'i * 64 - (j + 1) * dy')} END"""


@query("f4_directional", f"{EDGES}, {_LONG_EDGES}, an AS (SELECT * FROM (VALUES {_SLOPES}) t(angle, dx, dy)), o AS (SELECT blk, angle, p, {_DIRECTED} AS s FROM (SELECT blk, a, l, angle, dx, dy, p, p // 8 AS i, p % 8 AS j FROM e, an, (SELECT CAST(range AS INTEGER) AS p FROM range(64)))) SELECT blk, angle, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * (p + 1)) AS BIGINT) AS weighted FROM o GROUP BY ALL")
def directional(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction along eight directions, each with seven turns of three degrees."""
    return kernels.directional_predictions(_long_edges(spark, folder), ANGLES, _slope)


def _long_edges(spark: SparkSession, folder: str) -> DataFrame:
    """blk, a, l: the corner and sixteen samples above, and on the left."""
    right = A.blocks(spark, folder).select("frame", (F.col("by") + 1).alias("by"), (F.col("bx") - 1).alias("bx"), F.slice("v", F.lit(57), F.lit(8)).alias("right"))
    last = lambda c: F.array_repeat(F.get(c, F.lit(7)), 8)
    own = _edges(spark, folder).where("corner is not null").join(right, ["frame", "by", "bx"], "left")
    return own.select("blk", F.concat(F.array("corner"), "above", F.coalesce("right", last("above"))).alias("a"), F.concat(F.array("corner"), "left", last("left")).alias("l"))


#: The smoothing of edges by strength, of 16.
SMOOTH = ((0, 4, 8, 4, 0), (0, 5, 6, 5, 0), (2, 4, 4, 4, 2))


@query("f4_edge_filter", f"{EDGES}, {_LONG_EDGES}, s AS (SELECT blk, a, blk % 3 AS k, unnest(range(1, 17)) AS i FROM e), w AS (SELECT * FROM (VALUES {', '.join(f'({k}, {j}, {w})' for k, row in enumerate(SMOOTH) for j, w in enumerate(row))}) t(k, j, w)), f AS (SELECT blk, i, (CAST(sum(w * a[greatest(0, least(16, i + j - 2)) + 1]) AS BIGINT) + 8) >> 4 AS s FROM s JOIN w USING (k) GROUP BY blk, i) SELECT blk, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * i) AS BIGINT) AS weighted FROM f GROUP BY blk")
def edge_smoothing(spark: SparkSession, folder: str) -> DataFrame:
    """The upper edge smoothed with one of three strengths; the corner stays, and stands for what is before it."""
    kernel = F.get(F.array(*[F.array(*[F.lit(w) for w in row]) for row in SMOOTH]), (F.col("blk") % 3).cast("int"))
    own = B.fixed(_long_edges(spark, folder), "blk", a=F.col("a"), w=kernel)
    at = lambda i, j: F.get("a", fx.clip3(F.lit(0), F.lit(16), i + j - 2))
    smooth = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: fx.round2(F.aggregate(F.transform("w", lambda w, j: w * at(i, j)), F.lit(0), lambda t, x: t + x), 4))
    own = own.select("blk", smooth.alias("s"))
    return own.select("blk", B.total(F.col("s")).alias("total"), B.total(F.transform("s", lambda x, k: x * (k + 1))).alias("weighted"))


@query("f4_edge_upsample", f"{EDGES}, {_LONG_EDGES}, s AS (SELECT blk, a, unnest(range(0, 8)) AS i FROM e), f AS (SELECT blk, i, greatest(0, least(255, (9 * (a[i + 1] + a[i + 2]) - a[greatest(i - 1, 0) + 1] - a[least(i + 2, 8) + 1] + 8) >> 4)) AS half, a[i + 2] AS whole FROM s) SELECT blk, CAST(sum(half) AS BIGINT) AS halves, CAST(sum(half * (2 * i + 1) + whole * (2 * i + 2)) AS BIGINT) AS weighted FROM f GROUP BY blk")
def edge_upsampling(spark: SparkSession, folder: str) -> DataFrame:
    """The corner and eight samples above with samples between them."""
    at = lambda i: F.get("a", fx.clip3(F.lit(0), F.lit(8), i))
    half = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: fx.clip3(F.lit(0).cast("long"), F.lit(255).cast("long"), fx.round2(9 * (at(i) + at(i + 1)) - at(i - 1) - at(i + 2), 4)))
    own = _long_edges(spark, folder).select("blk", half.alias("h"), "a")
    whole = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("h", i) * (2 * i + 1) + F.get("a", i + 1) * (2 * i + 2))
    return own.select("blk", B.total(F.col("h")).alias("halves"), B.total(whole).alias("weighted"))


@query("f6_intra_paeth", f"""{EDGES}, n AS (SELECT p.blk, p.p, a.s AS a, l.s AS l, c.s AS c FROM pixels p JOIN above a ON p.frame = a.frame AND p."by" = a."by" AND p.bx = a.bx AND a.k = p.p % 8 JOIN left_ l ON p.frame = l.frame AND p."by" = l."by" AND p.bx = l.bx AND l.k = p.p // 8 JOIN corner c ON p.frame = c.frame AND p."by" = c."by" AND p.bx = c.bx),
o AS (SELECT blk, p, CASE WHEN abs(a - c) <= abs(l - c) AND abs(a - c) <= abs(a + l - 2 * c) THEN l WHEN abs(l - c) <= abs(a + l - 2 * c) THEN a ELSE c END AS s FROM n) SELECT blk, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * p) AS BIGINT) AS weighted FROM o GROUP BY blk""")
def intra_paeth(spark: SparkSession, folder: str) -> DataFrame:
    own = _edges(spark, folder).where("corner is not null").select("blk", B.paeth(F.col("above"), F.col("left"), F.col("corner")).alias("m"))
    return own.select("blk", B.total(F.col("m")).alias("total"), B.total(F.transform("m", lambda s, p: s * p)).alias("weighted"))


@query("f12_compound", f"WITH {A.PAIRS} SELECT blk, CAST(sum((s + r + 1) >> 1) AS BIGINT) AS average, CAST(sum((s * (p + 1) + r * (63 - p) + 32) >> 6) AS BIGINT) AS blend FROM pairs GROUP BY blk")
def compound(spark: SparkSession, folder: str) -> DataFrame:
    """Average, and blend with a mask that rises from 1 to 64 over the block."""
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda m: m.cast("long"))
    return A.pairs(spark, folder).select("blk", B.total(B.compound_average(F.col("v"), F.col("ref"))).alias("average"), B.total(B.mask_blend(F.col("v"), F.col("ref"), mask)).alias("blend"))


@query("d11_palette_cache", f"WITH {A.BLOCKS}, own AS (SELECT blk, list_slice(list_sort(list_distinct(v)), 1, 8) AS v FROM blocks), c AS (SELECT a.blk, list_sort(list_distinct(list_concat(a.v, b.v))) AS c FROM own a JOIN own b ON a.blk = b.blk + 1) SELECT blk, len(c) AS n, CAST(list_sum(c) AS BIGINT) AS total FROM c")
def palette_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The palettes (eight colours at most, of the whole block) of a block and the one before, merged."""
    palette = lambda c: F.slice(F.array_sort(F.array_distinct(c)), F.lit(1), F.lit(8))
    own = A.pairs(spark, folder).select("blk", B.palette_cache(palette("v"), palette("ref")).alias("c"))
    return own.select("blk", F.size("c").cast("long").alias("n"), B.total(F.col("c")).alias("total"))


def _lines_sql() -> str:
    return ", ".join(f"({d}, {p}, {B.line_of(d, *divmod(p, 8))})" for d in range(8) for p in range(64))


@query(
    "h6_cdef_direction",
    f"""WITH {A.PIXELS}, ln AS (SELECT * FROM (VALUES {_lines_sql()}) t(d, p, line)), sums AS (SELECT blk, d, line, CAST(sum(s - 128) AS BIGINT) AS t, count(*) AS n FROM pixels JOIN ln USING (p) GROUP BY ALL),
c AS (SELECT blk, d, CAST(sum(t * t * (840 // n)) AS BIGINT) AS cost FROM sums GROUP BY ALL), b AS (SELECT blk, arg_min(d, (-cost, d)) AS direction, max(cost) AS best FROM c GROUP BY blk)
SELECT b.blk, CAST(direction AS INTEGER) AS direction, CAST((best - cost) >> 10 AS BIGINT) AS variance FROM b JOIN c ON b.blk = c.blk AND c.d = (direction + 4) % 8""",
)
def cdef_direction(spark: SparkSession, folder: str) -> DataFrame:
    return B.cdef_direction(A.blocks(spark, folder), "blk", F.col("v"))
