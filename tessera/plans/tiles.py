"""Walks of tiles, neighbours' vectors, and the predictions whose tables are given (D, E, F, G, K10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tessera.functions import adapters as A, fx
from tessera.operators import blocks as B, frames, kernels, tiles
from tessera.plans.blocks import EDGES, _edges
from tessera.plans.registry import query



@query("d2_decode_tile", "SELECT vec_id // 250 AS gop, count(DISTINCT vec_id // 50) AS frames, true AS same FROM embeddings GROUP BY ALL")
def decode_tile(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of five pictures coded and decoded: whether the decoder's pictures are the encoder's."""
    return tiles.coded_groups(A.pixels(spark, folder), 5, 8.0).select("gop", "frames", "same")


@query("d4_block_modes")
def block_modes(spark: SparkSession, folder: str) -> DataFrame:
    """4x4 blocks by the mode that the walk gives them, a picture."""
    return tiles.block_table(A.pixels(spark, folder), 8.0).groupBy("frame", "mode", "skip").count()


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """frame, by, bx, blk, mv, ref: a vector and a reference for each block, functions of its samples."""
    total = B.total(F.col("v"))
    return A.blocks(spark, folder).select("blk", "frame", "by", "bx", (total % 7 - 3).alias("mv"), (total % 2).alias("ref"))


VECTORS = f'WITH {A.PIXELS}, mvs AS (SELECT blk, frame, "by", bx, CAST(sum(s) AS BIGINT) % 7 - 3 AS mv, CAST(sum(s) AS BIGINT) % 2 AS ref FROM pixels GROUP BY ALL)'
NEIGHBOURS = ((-1, 0, 4), (0, -1, 4), (-1, 1, 2), (-1, -1, 1), (-2, 0, 1), (0, -2, 1))
_SIDES = ", ".join(f"({k}, {dy}, {dx}, {w})" for k, (dy, dx, w) in enumerate(NEIGHBOURS))
SCANNED = f'{VECTORS}, n AS (SELECT * FROM (VALUES {_SIDES}) t(ord, dy, dx, w)), scan AS (SELECT b.blk, n.ord, n.w, m.mv FROM mvs b, n JOIN mvs m ON m.frame = b.frame AND m."by" = b."by" + n.dy AND m.bx = b.bx + n.dx AND m.ref = b.ref)'.replace("FROM mvs b, n JOIN mvs m", "FROM mvs b CROSS JOIN n JOIN mvs m")


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    """blk, ord, w, mv: vectors of neighbours with the block's reference, in scan order. Each block goes to the places
    that look at it, so that the join is on equal places."""
    own = _vectors(spark, folder)
    sides = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for k, (dy, dx, w) in enumerate(NEIGHBOURS)])
    seen = own.select("frame", "by", "bx", "ref", "mv", F.explode(sides).alias("n"))
    seen = seen.select("frame", (F.col("by") - F.col("n.dy")).alias("by"), (F.col("bx") - F.col("n.dx")).alias("bx"), "ref", "mv", "n.ord", "n.w")
    return seen.join(own.select("blk", "frame", "by", "bx", "ref"), ["frame", "by", "bx", "ref"]).select("blk", "ord", "w", "mv")


@query("e3_scan_neighbours", f"{SCANNED} SELECT blk, ord, w, mv FROM scan")
def scan_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _scanned(spark, folder)


@query("e1_find_mv_stack", f"{SCANNED}, g AS (SELECT blk, mv, CAST(sum(w) AS BIGINT) AS w, min(ord) AS first FROM scan GROUP BY ALL) SELECT blk, mv, w, row_number() OVER (PARTITION BY blk ORDER BY w DESC, first) AS rank FROM g")
def find_mv_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct vectors of the neighbours with summed weights, ranked."""
    seen = _scanned(spark, folder).groupBy("blk", "mv").agg(F.sum("w").alias("w"), F.min("ord").alias("first"))
    return seen.select("blk", "mv", "w", F.row_number().over(Window.partitionBy("blk").orderBy(F.col("w").desc(), "first")).alias("rank"))


@query("e4_temporal_scan", f'{VECTORS} SELECT b.blk, m.mv, abs(m.mv) >= 2 AS moves FROM mvs b JOIN mvs m ON m.frame = b.frame - 1 AND m."by" = b."by" AND m.bx = b.bx')
def temporal_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The vector that the frame before has at a block's place."""
    own = _vectors(spark, folder)
    past = own.select((F.col("frame") + 1).alias("frame"), "by", "bx", "mv")
    return own.drop("mv").join(past, ["frame", "by", "bx"]).select("blk", "mv", (F.abs("mv") >= 2).alias("moves"))


@query("e7_extra_search", f"{SCANNED}, g AS (SELECT blk, count(DISTINCT mv) AS n, max(mv) AS top FROM scan GROUP BY blk) SELECT m.blk, coalesce(n, 0) AS found, greatest(-16, least(16, CASE WHEN coalesce(n, 0) < 2 THEN -m.mv * 8 ELSE top * 8 END)) AS mv FROM mvs m LEFT JOIN g USING (blk)")
def extra_search(spark: SparkSession, folder: str) -> DataFrame:
    """Where fewer than two vectors were found, the block's own turned round; clamped to the surroundings."""
    seen = _scanned(spark, folder).groupBy("blk").agg(F.countDistinct("mv").alias("n"), F.max("mv").alias("top"))
    own = _vectors(spark, folder).select("blk", F.col("mv").alias("m")).join(seen, "blk", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return own.select("blk", n.alias("found"), fx.clip3(F.lit(-16).cast("long"), F.lit(16).cast("long"), F.when(n < 2, -F.col("m") * 8).otherwise(F.col("top") * 8)).alias("mv"))


@query("e8_overlappable", f'{VECTORS} SELECT b.blk FROM mvs b WHERE EXISTS (SELECT 1 FROM mvs m WHERE m.frame = b.frame AND m.ref = 1 AND (m."by" = b."by" - 1 AND m.bx = b.bx OR m."by" = b."by" AND m.bx = b.bx - 1))')
def overlappable(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with an inter neighbour above or to the left: a semi join on the places that neighbours cover."""
    own = _vectors(spark, folder)
    inter = own.where("ref = 1")
    covers = inter.select("frame", (F.col("by") + 1).alias("by"), "bx").unionByName(inter.select("frame", "by", (F.col("bx") + 1).alias("bx")))
    return own.join(covers, ["frame", "by", "bx"], "left_semi").select("blk")


@query("e8_not_overlappable", f'{VECTORS} SELECT m.blk FROM mvs m WHERE NOT EXISTS (SELECT 1 FROM mvs n WHERE n.ref = 1 AND n.frame = m.frame AND ((n."by" = m."by" - 1 AND n.bx = m.bx) OR (n."by" = m."by" AND n.bx = m.bx - 1)))')
def not_overlappable(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks without an inter block above or on the left: an anti join."""
    own = _vectors(spark, folder)
    inter = own.where("ref = 1")
    covers = inter.select("frame", (F.col("by") + 1).alias("by"), "bx").unionByName(inter.select("frame", "by", (F.col("bx") + 1).alias("bx")))
    return own.join(covers, ["frame", "by", "bx"], "left_anti").select("blk")


WEIGHTS = [256 - 28 * k for k in range(8)]  # given in place of the format's table
_W = ", ".join(f"({k}, {w})" for k, w in enumerate(WEIGHTS))
_JOINED = 'above a ON p.frame = a.frame AND p."by" = a."by" AND p.bx = a.bx AND a.k = p.p % 8 JOIN left_ l ON p.frame = l.frame AND p."by" = l."by" AND p.bx = l.bx AND l.k = p.p // 8'


@query("f5_intra_smooth", f'{EDGES}, w AS (SELECT * FROM (VALUES {_W}) t(k, w)), o AS (SELECT p.blk, p.p, (wy.w * a.s + (256 - wy.w) * l7.s + wx.w * l.s + (256 - wx.w) * a7.s + 256) >> 9 AS s FROM pixels p JOIN {_JOINED} JOIN above a7 ON p.frame = a7.frame AND p."by" = a7."by" AND p.bx = a7.bx AND a7.k = 7 JOIN left_ l7 ON p.frame = l7.frame AND p."by" = l7."by" AND p.bx = l7.bx AND l7.k = 7 JOIN w wy ON wy.k = p.p // 8 JOIN w wx ON wx.k = p.p % 8) SELECT blk, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * p) AS BIGINT) AS weighted FROM o GROUP BY blk')
def intra_smooth(spark: SparkSession, folder: str) -> DataFrame:
    """Both edges blended towards their far ends, with weights given."""
    w = F.array(*[F.lit(x) for x in WEIGHTS])
    a, l = F.col("above"), F.col("left")

    def one(p: Column) -> Column:
        i, j = fx.idiv(p, 8).cast("int"), p % 8
        return fx.round2(F.get(w, i) * F.get(a, j) + (256 - F.get(w, i)) * l[7] + F.get(w, j) * F.get(l, i) + (256 - F.get(w, j)) * a[7], 9)

    own = _edges(spark, folder).where("above is not null and left is not null").select("blk", F.transform(F.sequence(F.lit(0), F.lit(63)), one).alias("m"))
    return own.select("blk", B.total(F.col("m")).alias("total"), B.total(F.transform("m", lambda s, p: s * p)).alias("weighted"))


_ONE_EDGE = {"vertical": "wy.w * a.s + (256 - wy.w) * l7.s", "horizontal": "wx.w * l.s + (256 - wx.w) * a7.s"}


@query("f5_intra_smooth_sides", f'{EDGES}, w AS (SELECT * FROM (VALUES {_W}) t(k, w)), o AS (SELECT p.blk, p.p, ({_ONE_EDGE["vertical"]} + 128) >> 8 AS v, ({_ONE_EDGE["horizontal"]} + 128) >> 8 AS h FROM pixels p JOIN {_JOINED} JOIN above a7 ON p.frame = a7.frame AND p."by" = a7."by" AND p.bx = a7.bx AND a7.k = 7 JOIN left_ l7 ON p.frame = l7.frame AND p."by" = l7."by" AND p.bx = l7.bx AND l7.k = 7 JOIN w wy ON wy.k = p.p // 8 JOIN w wx ON wx.k = p.p % 8) SELECT blk, CAST(sum(v) AS BIGINT) AS vertical, CAST(sum(v * p) AS BIGINT) AS vertical_weighted, CAST(sum(h) AS BIGINT) AS horizontal, CAST(sum(h * p) AS BIGINT) AS horizontal_weighted FROM o GROUP BY blk')
def intra_smooth_sides(spark: SparkSession, folder: str) -> DataFrame:
    """The other two smooth modes: one edge blended towards the far end of the other."""
    w, a, l = F.array(*[F.lit(x) for x in WEIGHTS]), F.col("above"), F.col("left")
    row, column = (lambda p: fx.idiv(p, 8).cast("int")), (lambda p: p % 8)
    down = lambda p: fx.round2(F.get(w, row(p)) * F.get(a, column(p)) + (256 - F.get(w, row(p))) * l[7], 8)
    along = lambda p: fx.round2(F.get(w, column(p)) * F.get(l, row(p)) + (256 - F.get(w, column(p))) * a[7], 8)
    places = F.sequence(F.lit(0), F.lit(63))
    own = _edges(spark, folder).where("above is not null and left is not null").select("blk", F.transform(places, down).alias("v"), F.transform(places, along).alias("h"))
    weighted = lambda c: B.total(F.transform(c, lambda s, p: s * p))
    return own.select("blk", B.total(F.col("v")).alias("vertical"), weighted("v").alias("vertical_weighted"), B.total(F.col("h")).alias("horizontal"), weighted("h").alias("horizontal_weighted"))


@query("f7_recursive_intra")
def recursive_intra(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive filter prediction with taps given."""
    own = _edges(spark, folder).where("corner is not null")
    return kernels.recursive_predictions(own.select("blk", F.concat(F.array("corner"), "above").alias("above"), "left"))


_DIR = "CASE blk % 3 WHEN 0 THEN a.s WHEN 1 THEN l.s ELSE (a.s + l.s + 1) >> 1 END"


@query("f1_prediction_dispatch", f"{EDGES} SELECT p.blk, p.blk % 3 AS mode, CAST(sum({_DIR.replace('blk', 'p.blk')}) AS BIGINT) AS total FROM pixels p JOIN {_JOINED} GROUP BY p.blk")
def prediction_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Vertical, horizontal or mean of both, by the block's mode."""
    own = _edges(spark, folder).where("above is not null and left is not null")
    across, down = F.flatten(F.array_repeat(F.col("above"), 8)), F.flatten(F.transform("left", lambda s: F.array_repeat(s, 8)))
    mode = F.col("blk") % 3
    made = F.when(mode == 0, B.total(across)).when(mode == 1, B.total(down)).otherwise(B.total(B.compound_average(across, down)))
    return own.select("blk", mode.alias("mode"), made.alias("total"))


LADDER = ((9, 7), (11, 5), (12, 4), (13, 3))  # given in place of the format's weights, by the ratio of distances


@query("f13_distance_weights", f"WITH {A.RATELOG}, d AS (SELECT event_id, bits % 31 + 1 AS a, bits % 17 + 1 AS b FROM ratelog) SELECT event_id, a, b, CASE WHEN a * 2 < b * 3 THEN 9 WHEN a < b * 3 THEN 11 WHEN a < b * 5 THEN 12 ELSE 13 END AS w0, CASE WHEN a * 2 < b * 3 THEN 7 WHEN a < b * 3 THEN 5 WHEN a < b * 5 THEN 4 ELSE 3 END AS w1 FROM d")
def distance_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of two references by their distances."""
    own = A.ratelog(spark, folder).select("event_id", (F.col("bits") % 31 + 1).alias("a"), (F.col("bits") % 17 + 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    step = F.when(a * 2 < b * 3, 0).when(a < b * 3, 1).when(a < b * 5, 2).otherwise(3)
    pick = lambda k: F.get(F.array(*[F.lit(p[k]) for p in LADDER]), step)
    return own.select("event_id", "a", "b", pick(0).alias("w0"), pick(1).alias("w1"))


@query("f14_obmc", f'WITH {A.PIXELS}, o AS (SELECT p.blk, p.p, CASE WHEN p.p // 8 < 4 THEN ((64 - 8 * (4 - p.p // 8)) * p.s + 8 * (4 - p.p // 8) * a.s + 32) >> 6 ELSE p.s END AS s, l.s AS l FROM pixels p JOIN pixels a ON a.frame = p.frame AND a.bx = p.bx AND a."by" = p."by" - 1 AND a.p = p.p JOIN pixels l ON l.frame = p.frame AND l.bx = p.bx - 1 AND l."by" = p."by" AND l.p = p.p) SELECT blk, CAST(sum(CASE WHEN p % 8 < 4 THEN ((64 - 8 * (4 - p % 8)) * s + 8 * (4 - p % 8) * l + 32) >> 6 ELSE s END) AS BIGINT) AS total FROM o GROUP BY blk')
def obmc(spark: SparkSession, folder: str) -> DataFrame:
    """The upper half blended with what the block above predicts (here: its samples), then the left half with the block on the left, by a mask given."""
    own = A.blocks(spark, folder)
    above = own.select("frame", (F.col("by") + 1).alias("by"), "bx", F.col("v").alias("a"))
    left = own.select("frame", "by", (F.col("bx") + 1).alias("bx"), F.col("v").alias("l"))
    mask = lambda at: F.array(*[F.lit(64 - 8 * (4 - at(p)) if at(p) < 4 else 64).cast("long") for p in range(64)])
    both = own.join(above, ["frame", "by", "bx"]).join(left, ["frame", "by", "bx"])
    both = B.fixed(both, "blk", m=B.mask_blend(F.col("v"), F.col("a"), mask(lambda p: p // 8)), l=F.col("l"))
    return both.select("blk", B.total(B.mask_blend(F.col("m"), F.col("l"), mask(lambda p: p % 8))).alias("total"))


def _frames_with_past(spark: SparkSession, folder: str) -> DataFrame:
    own = A.pixels(spark, folder).select("frame", "y", "x", "s")
    past = own.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col("s").alias("r"))
    return own.join(past, ["frame", "y", "x"])


@query("f16_block_warp")
def block_warp(spark: SparkSession, folder: str) -> DataFrame:
    """Affine prediction from the frame before, bilinear in place of the format's filters."""
    return kernels.warps(_frames_with_past(spark, folder))


@query("f10_inter_driver", f"WITH {A.PIXELS} SELECT a.blk, CAST(sum(abs(a.s - b.s)) AS BIGINT) AS error FROM pixels a JOIN pixels b ON b.frame = a.frame - 1 AND b.y = greatest(0, least(39, a.y + a.blk % 3 - 1)) AND b.x = greatest(0, least(79, a.x + a.blk % 5 - 2)) GROUP BY a.blk")
def inter_driver(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks predicted from the frame before, each with its own vector (a function of its number)."""

    def error(now, past, there):
        number = np.arange(now.size // 64).reshape(now.shape[0] // 8, now.shape[1] // 8)  # frames of 50 blocks: modulo 5 and, with the frame, modulo 3
        at = lambda plane, k: frames.moved(plane, k - 1, frames.spread(number % 5 - 2))
        return {f"e{k}": frames.block_errors(now, at(past, k), at(there, k)) for k in range(3)}

    found = frames.with_past(A.blocks(spark, folder), error, ["e0", "e1", "e2"])
    return found.select("blk", F.get(F.array("e0", "e1", "e2"), (F.col("blk") % 3).cast("int")).alias("error")).where("error >= 0")


@query("f17_wedge_masks", f"WITH {A.PAIRS}, m AS (SELECT *, greatest(0, least(64, 32 + 8 * CASE blk % 4 WHEN 0 THEN j - 4 WHEN 1 THEN i - 4 WHEN 2 THEN i + j - 7 ELSE i - j END)) AS m FROM pairs) SELECT blk, blk % 4 AS direction, CAST(sum((m * s + (64 - m) * r + 32) >> 6) AS BIGINT) AS total FROM m GROUP BY blk")
def wedge_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Two predictions blended along an edge: masks are built once from a rule, four directions, and looked up."""
    rule = (lambda i, j: j - 4, lambda i, j: i - 4, lambda i, j: i + j - 7, lambda i, j: i - j)
    masks = F.array(*[F.array(*[F.lit(max(0, min(64, 32 + 8 * f(p // 8, p % 8)))).cast("long") for p in range(64)]) for f in rule])
    own = B.fixed(A.pairs(spark, folder), "blk", v=F.col("v"), ref=F.col("ref"), mask=F.get(masks, (F.col("blk") % 4).cast("int")))
    return own.select("blk", (F.col("blk") % 4).alias("direction"), B.total(B.mask_blend(F.col("v"), F.col("ref"), F.col("mask"))).alias("total"))


@query("g1_transform_blocks", f"WITH {A.PAIRS} SELECT blk, i // 4 AS ty, j // 4 AS tx, CAST(sum(s - r) AS BIGINT) AS dc, CAST(max(abs(s - r)) AS INTEGER) AS largest FROM pairs GROUP BY ALL")
def transform_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each 4x4 transform block of a residual."""
    own = B.fixed(A.pairs(spark, folder), "blk", d=B.difference(F.col("v"), F.col("ref")))
    part = lambda y, x: F.array(*[B.at(F.col("d"), y + i, x + j) for i in range(4) for j in range(4)])
    cells = F.array(*[F.struct(F.lit(y // 4).alias("ty"), F.lit(x // 4).alias("tx"), part(y, x).alias("d")) for y in (0, 4) for x in (0, 4)])
    own = own.select("blk", F.explode(cells).alias("c"))
    return own.select("blk", "c.ty", "c.tx", B.total(F.col("c.d")).alias("dc"), F.array_max(F.transform("c.d", lambda x: F.abs(x))).alias("largest"))


@query("g2_tx_size", f"WITH {A.RATELOG}, b AS (SELECT event_id, 4 << CAST(bits % 6 AS INTEGER) AS w, 4 << CAST(bits // 6 % 6 AS INTEGER) AS h, bits % 3 AS depth FROM ratelog) SELECT event_id, w, h, greatest(4, least(w, 64) >> CASE WHEN w >= h THEN depth::INT ELSE 0 END) AS tw, greatest(4, least(h, 64) >> CASE WHEN h >= w THEN depth::INT ELSE 0 END) AS th FROM b")
def tx_size(spark: SparkSession, folder: str) -> DataFrame:
    """Transform size of a block: 64 at most each way, the longer sides halved by the depth, 4 at least."""
    own = A.ratelog(spark, folder).select("event_id", fx.shl(F.lit(4), F.col("bits") % 6).alias("w"), fx.shl(F.lit(4), fx.idiv(F.col("bits"), 6) % 6).alias("h"), (F.col("bits") % 3).alias("depth"))
    side = lambda a, b: F.greatest(F.lit(4), fx.shr(F.least(F.col(a), F.lit(64)), F.when(F.col(a) >= F.col(b), F.col("depth")).otherwise(0)))
    return own.select("event_id", "w", "h", side("w", "h").alias("tw"), side("h", "w").alias("th"))


_SET = "CASE WHEN greatest(w, h) > 32 THEN 'dct' WHEN inter THEN CASE WHEN reduced OR greatest(w, h) = 32 THEN 'inter3' WHEN least(w, h) = 16 THEN 'inter2' ELSE 'inter1' END WHEN greatest(w, h) = 32 THEN 'dct' WHEN reduced OR least(w, h) = 16 THEN 'intra2' ELSE 'intra1' END"


@query("g2_tx_set", f"WITH {A.RATELOG}, b AS (SELECT event_id, 4 << CAST(bits % 5 AS INTEGER) AS w, 4 << CAST(greatest(0, least(4, bits % 5 + bits // 5 % 5 - 2)) AS INTEGER) AS h, bits % 2 = 1 AS inter, bits // 25 % 4 = 0 AS reduced FROM ratelog) SELECT event_id, w, h, {_SET} AS kind FROM b")
def tx_set(spark: SparkSession, folder: str) -> DataFrame:
    """Which transform types a size may have: the sides are at most four times each other."""
    bits = F.col("bits")
    own = A.ratelog(spark, folder).select("event_id", fx.shl(F.lit(4), bits % 5).alias("w"), fx.shl(F.lit(4), fx.clip3(F.lit(0).cast("long"), F.lit(4).cast("long"), bits % 5 + fx.idiv(bits, 5) % 5 - 2)).alias("h"), (bits % 2 == 1).alias("inter"), (fx.idiv(bits, 25) % 4 == 0).alias("reduced"))
    longer, shorter = F.greatest("w", "h"), F.least("w", "h")
    of_inter = F.when(F.col("reduced") | (longer == 32), "inter3").when(shorter == 16, "inter2").otherwise("inter1")
    of_intra = F.when(longer == 32, "dct").when(F.col("reduced") | (shorter == 16), "intra2").otherwise("intra1")
    return own.select("event_id", "w", "h", F.when(longer > 32, "dct").when(F.col("inter"), of_inter).otherwise(of_intra).alias("kind"))


@query("g4_scan_orders", "SELECT CAST(p AS INTEGER) AS p, row_number() OVER (ORDER BY p // 8 + p % 8, p // 8) - 1 AS diagonal, p AS by_row, (p % 8) * 8 + p // 8 AS by_column FROM (SELECT unnest(range(64)) AS p)")
def scan_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Places of coefficients in the three orders, as a table to join with."""
    places = {p: k for k, p in enumerate(B.diagonal_scan())}
    diagonal = F.array(*[F.lit(places[p]).cast("long") for p in range(64)])
    own = spark.range(64).withColumnRenamed("id", "p")
    return own.select(F.col("p").cast("int").alias("p"), F.get(diagonal, F.col("p").cast("int")).alias("diagonal"), F.col("p").alias("by_row"), (F.col("p") % 8 * 8 + fx.idiv(F.col("p"), 8)).alias("by_column"))


@query("k10_motion_fast")
def motion_fast(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors by shrinking squares, which the full search bounds from below."""
    return kernels.fast_searches(_frames_with_past(spark, folder))
