"""Header fields and geometry (B, D, E, N): numbers from digests of whole texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import adapters as A, bits, fx
from tessera.operators import headers as H
from tessera.plans.registry import query
from tessera.plans.scalars import WITH, _hex



def _fields(spark: SparkSession, folder: str, **at: tuple[int, int]) -> DataFrame:
    return A.digests(spark, folder).select("doc_id", "data", *[bits.f(F.col("data"), a, n).alias(k) for k, (a, n) in at.items()])


def _sql(**at: tuple[int, int]) -> str:
    return f"{WITH}, f AS (SELECT doc_id, hex, {', '.join(f'{_hex(a, n)} AS {k}' for k, (a, n) in at.items())} FROM digests)"


HDR = {"kind": (0, 1), "cll": (8, 16), "fall": (24, 16), "top": (40, 32)}


@query("b4_metadata", f"{_sql(**HDR)} SELECT doc_id, CASE WHEN kind = 0 THEN cll END AS max_cll, CASE WHEN kind = 0 THEN fall END AS max_fall, CASE WHEN kind = 1 THEN top END AS luminance FROM f")
def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Content light levels or mastering luminance, by type."""
    own = _fields(spark, folder, **HDR)
    return own.select("doc_id", F.when(F.col("kind") == 0, F.col("cll")).alias("max_cll"), F.when(F.col("kind") == 0, F.col("fall")).alias("max_fall"), F.when(F.col("kind") == 1, F.col("top")).alias("luminance"))


COLOR = {"profile": (0, 2), "high": (2, 1), "twelve": (3, 1), "mono": (4, 1), "srgb": (5, 1), "sx": (6, 1), "sy": (7, 1)}
_DEPTH = "CASE WHEN profile % 3 = 2 AND high = 1 THEN CASE WHEN twelve = 1 THEN 12 ELSE 10 END WHEN high = 1 THEN 10 ELSE 8 END"


@query("b3_color_config", f"{_sql(**COLOR)}, d AS (SELECT *, profile % 3 AS p, {_DEPTH} AS depth, CASE WHEN profile % 3 = 1 THEN 0 ELSE mono END AS m FROM f) SELECT doc_id, p AS profile, depth, m AS mono, CASE WHEN m = 1 THEN 1 WHEN srgb = 1 OR p = 1 THEN 0 WHEN p = 0 THEN 1 WHEN depth = 12 THEN sx ELSE 1 END AS ssx, CASE WHEN m = 1 THEN 1 WHEN srgb = 1 OR p = 1 THEN 0 WHEN p = 0 THEN 1 WHEN depth = 12 THEN sx * sy ELSE 0 END AS ssy FROM d")
def color_config(spark: SparkSession, folder: str) -> DataFrame:
    """Depth and subsampling by profile; the sRGB triple implies 4:4:4."""
    own = _fields(spark, folder, **COLOR).withColumn("p", F.col("profile") % 3)
    p, one, nil = F.col("p"), F.lit(1).cast("long"), F.lit(0).cast("long")
    depth = F.when((p == 2) & (F.col("high") == 1), F.when(F.col("twelve") == 1, 12).otherwise(10)).when(F.col("high") == 1, 10).otherwise(8)
    own = own.withColumn("depth", depth).withColumn("m", F.when(p == 1, nil).otherwise(F.col("mono")))
    plain = F.when(F.col("m") == 1, one).when((F.col("srgb") == 1) | (p == 1), nil).when(p == 0, one)
    return own.select("doc_id", p.alias("profile"), "depth", F.col("m").alias("mono"), plain.when(F.col("depth") == 12, F.col("sx")).otherwise(one).alias("ssx"), plain.when(F.col("depth") == 12, F.col("sx") * F.col("sy")).otherwise(nil).alias("ssy"))


HINTS = {f"h{k}": (4 * k, 4) for k in range(8)} | {"last": (40, 3), "golden": (43, 3)}


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(spark, folder, **HINTS).select("doc_id", "last", "golden", F.array(*[F.col(f"h{k}") - 8 for k in range(8)]).alias("d"))


_D = ", ".join(f"h{k} - 8" for k in range(8))


def _pick(name: str, source: str, side: str, pick: str) -> str:
    """SQL: fills reference ``name`` in ``source`` with the latest or earliest free slot of a side, and marks it used."""
    order = "max" if pick == "latest" else "min"
    free = f"list_filter(list_transform(range(8), lambda k: [d[k + 1], k]), lambda x: NOT list_contains(used, x[2]) AND x[1] {'>=' if side == 'back' else '<'} 0)"
    return f"{name} AS (SELECT *, list_append(used, coalesce(v_{name}, -1)) AS used2 FROM (SELECT *, list_{order}({free})[2] AS v_{name} FROM {source}))"


def _refs_sql() -> str:
    steps, source = [], "s0"
    for name, side, pick in (("alt", "back", "latest"), ("bwd", "back", "earliest"), ("alt2", "back", "earliest"), ("l2", "fore", "latest"), ("l3", "fore", "latest"), ("bw2", "fore", "latest"), ("a22", "fore", "latest"), ("al2", "fore", "latest")):
        skip = {"bw2": "v_bwd", "a22": "v_alt2", "al2": "v_alt"}.get(name)
        made = _pick(name, source, side, pick)
        if skip:  # a reference that has its slot does not take another
            made = made.replace(f"list_{'max' if pick == 'latest' else 'min'}(", f"CASE WHEN {skip} IS NOT NULL THEN NULL ELSE list_max(").replace(f")[2] AS v_{name}", f")[2] END AS v_{name}")
        steps.append(made)
        steps.append(f"{name}_ AS (SELECT * EXCLUDE (used, used2), used2 AS used FROM {name})")
        source = f"{name}_"
    return ", ".join(steps), source


_STEPS, _FINAL = _refs_sql()


@query("b6_set_frame_refs", f"{_sql(**HINTS)}, s0 AS (SELECT doc_id, last, golden, [{_D}] AS d, [last, golden] AS used FROM f), {_STEPS}, e AS (SELECT *, list_min(list_transform(range(8), lambda k: [d[k + 1], k]))[2] AS early FROM {_FINAL}) SELECT doc_id, CAST(last AS INTEGER) AS r0, CAST(coalesce(v_l2, early) AS INTEGER) AS r1, CAST(coalesce(v_l3, early) AS INTEGER) AS r2, CAST(golden AS INTEGER) AS r3, CAST(coalesce(v_bwd, v_bw2, early) AS INTEGER) AS r4, CAST(coalesce(v_alt2, v_a22, early) AS INTEGER) AS r5, CAST(coalesce(v_alt, v_al2, early) AS INTEGER) AS r6 FROM e")
def set_frame_refs(spark: SparkSession, folder: str) -> DataFrame:
    own = _distances(spark, folder).select("doc_id", H.frame_refs(F.col("d"), F.col("last"), F.col("golden")).alias("r"))
    return own.select("doc_id", *[F.col("r")[k].alias(f"r{k}") for k in range(7)])


@query("b10_skip_mode", f"{_sql(**HINTS)}, s AS (SELECT doc_id, list_slice([{_D}], 1, 7) AS d FROM f), p AS (SELECT doc_id, list_transform(range(7), lambda k: [d[k + 1], -k]) AS p FROM s), b AS (SELECT doc_id, list_max(list_filter(p, lambda x: x[1] < 0)) AS f, list_min(list_transform(list_filter(p, lambda x: x[1] > 0), lambda x: [x[1], -x[2]])) AS b, p FROM p), g AS (SELECT doc_id, -f[2] AS f, coalesce(b[2], -list_max(list_filter(p, lambda x: x[1] < f[1]))[2]) AS o FROM b) SELECT doc_id, f IS NOT NULL AND o IS NOT NULL AS allowed, CASE WHEN f IS NOT NULL AND o IS NOT NULL THEN CAST(least(f, o) AS INTEGER) END AS a, CASE WHEN f IS NOT NULL AND o IS NOT NULL THEN CAST(greatest(f, o) AS INTEGER) END AS b FROM g")
def skip_mode(spark: SparkSession, folder: str) -> DataFrame:
    own = _distances(spark, folder).select("doc_id", H.skip_mode_frames(F.slice("d", F.lit(1), F.lit(7))).alias("s"))
    return own.select("doc_id", F.col("s").isNotNull().alias("allowed"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))


SIZE = {"w": (0, 13), "h": (13, 13), "den": (26, 3)}


@query("b7_frame_size", f"{_sql(**SIZE)}, s AS (SELECT *, ((w + 16) * 8 + (den + 9) // 2) // (den + 9) AS cw FROM f) SELECT doc_id, w + 16 AS upscaled, cw AS coded, 2 * ((cw + 7) >> 3) AS mi_cols, 2 * ((h + 16 + 7) >> 3) AS mi_rows FROM s")
def frame_size(spark: SparkSession, folder: str) -> DataFrame:
    own = _fields(spark, folder, **SIZE).withColumn("cw", H.superres(F.col("w") + 16, F.col("den") + 9))
    return own.select("doc_id", (F.col("w") + 16).alias("upscaled"), F.col("cw").alias("coded"), H.mi_units(F.col("cw")).alias("mi_cols"), H.mi_units(F.col("h") + 16).alias("mi_rows"))


@query("b8_tile_info", f"{_sql(n=(0, 8), log2=(8, 2))}, t AS (SELECT doc_id, n + 1 AS n, (n + 1 + (1 << log2::INT) - 1) >> log2::INT AS w FROM f) SELECT doc_id, unnest(range(0, n, w)) * 16 AS start, w AS width FROM t")
def tile_info(spark: SparkSession, folder: str) -> DataFrame:
    """One row a tile column of uniform spacing."""
    own = _fields(spark, folder, n=(0, 8), log2=(8, 2)).select("doc_id", (F.col("n") + 1).alias("n"), "log2")
    width = fx.shr(F.col("n") + fx.shl(F.lit(1).cast("long"), F.col("log2")) - 1, F.col("log2"))
    return own.select("doc_id", F.explode(H.uniform_starts(F.col("n"), F.col("log2"), 4)).alias("start"), width.alias("width"))


@query("b8_tile_log2", f"{_sql(b=(0, 6), t=(6, 12))} SELECT doc_id, CAST((SELECT min(k) FROM range(32) r(k) WHERE ((b + 1) << k::INT) >= t) AS INTEGER) AS k FROM f")
def tile_log2(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(spark, folder, b=(0, 6), t=(6, 12)).select("doc_id", H.tile_log2(F.col("b") + 1, F.col("t")).alias("k"))


POINTS = {f"p{k}": (4 * k, 4) for k in range(4)}


@query("b12_points_increase", f"{_sql(**POINTS)} SELECT doc_id, p0 < p1 AND p1 < p2 AND p2 < p3 AS valid FROM f")
def points_increase(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(spark, folder, **POINTS).select("doc_id", H.increasing(F.array(*POINTS)).alias("valid"))


@query("b14_qindex", f"{_sql(base=(0, 8), on_=(8, 1), delta=(9, 9))} SELECT doc_id, CASE WHEN on_ = 0 THEN base ELSE greatest(0, least(255, base + delta - 256)) END AS q FROM f")
def qindex(spark: SparkSession, folder: str) -> DataFrame:
    own = _fields(spark, folder, base=(0, 8), on_=(8, 1), delta=(9, 9))
    return own.select("doc_id", H.q_index(F.col("base"), F.when(F.col("on_") == 1, F.col("delta") - 256)).alias("q"))


@query("b16_check_color", f"{_sql(cp=(0, 9), tc=(9, 8), mc=(17, 2), pos=(19, 3))} SELECT doc_id, CASE WHEN cp > 255 THEN 'code points' WHEN pos > 3 THEN 'sample position' WHEN mc = 0 THEN 'identity matrix' END AS error FROM f")
def check_color(spark: SparkSession, folder: str) -> DataFrame:
    own = _fields(spark, folder, cp=(0, 9), tc=(9, 8), mc=(17, 2), pos=(19, 3))
    return own.select("doc_id", H.color_error(F.col("cp"), F.col("tc"), F.col("mc"), F.col("pos")).alias("error"))


PLACE = {"row": (0, 5), "col": (5, 5)}


@query("d3_partition_tree", f"WITH RECURSIVE t AS (SELECT 0 AS depth, 0 AS y, 0 AS x, 64 AS size UNION ALL SELECT depth + 1, y + dy * size // 2, x + dx * size // 2, size // 2 FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) q(dy, dx) WHERE size > 8 AND (depth + y // 8 + x // 8) % 2 = 0) SELECT d.frame, t.depth, t.y, t.x, t.size FROM t, (SELECT DISTINCT vec_id // 50 AS frame FROM embeddings) d")
def partition_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of a superblock's tree in each frame: a level is the split nodes of the one above."""
    level = A.blocks(spark, folder).select("frame").distinct().select("frame", *[F.lit(v).alias(n) for n, v in (("depth", 0), ("y", 0), ("x", 0), ("size", 64))])
    nodes = level
    quarters = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)])
    for _ in range(3):  # 64, 32, 16: the tree's own depth
        half = F.expr("size div 2").cast("int")
        split = level.where("size > 8 and (depth + y div 8 + x div 8) % 2 = 0").select("*", F.explode(quarters).alias("q"))
        level = split.select("frame", (F.col("depth") + 1).alias("depth"), (F.col("y") + F.col("q.dy") * half).alias("y"), (F.col("x") + F.col("q.dx") * half).alias("x"), half.alias("size"))
        nodes = nodes.unionByName(level)
    return nodes


@query("d12_wavefront_order", f"WITH {A.PIXELS} SELECT blk, p, row_number() OVER (PARTITION BY blk ORDER BY p // 8 + p % 8, p // 8) - 1 AS place FROM pixels")
def wavefront_order(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each sample in the order by anti-diagonals."""
    order = {p: k for k, p in enumerate(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8)))}
    places = F.array(*[F.lit(order[p]).cast("long") for p in range(64)])
    return A.blocks(spark, folder).select("blk", F.posexplode(places).alias("p", "place"))


@query("d15_reference_counts", f"{_sql(a=(0, 3), b=(3, 3), c=(6, 3), d=(9, 3))} SELECT doc_id, CAST((a > 0 AND a < 5)::INT + (b > 0 AND b < 5)::INT + (c > 0 AND c < 5)::INT + (d > 0 AND d < 5)::INT AS INTEGER) AS forward, CAST((a >= 5)::INT + (b >= 5)::INT + (c >= 5)::INT + (d >= 5)::INT AS INTEGER) AS backward FROM f")
def reference_counts(spark: SparkSession, folder: str) -> DataFrame:
    """References of the neighbours by direction, the context of the block's own."""
    own = _fields(spark, folder, a=(0, 3), b=(3, 3), c=(6, 3), d=(9, 3))
    count = lambda test: F.size(F.filter(F.array("a", "b", "c", "d"), test))
    return own.select("doc_id", count(lambda r: (r > 0) & (r < 5)).alias("forward"), count(lambda r: r >= 5).alias("backward"))


@query("d19_block_decoded", f"{_sql(row=(0, 5), col=(5, 5), w=(10, 4), h=(14, 4))} SELECT doc_id, row - 1 AS y, col - 1 AS x, NOT (row - 1 = 16 AND col - 1 = -1) AND (row - 1 < 0 AND col - 1 < w + 1 OR NOT (row - 1 < 0 AND col - 1 < w + 1) AND col - 1 < 0 AND row - 1 < h + 1) AS decoded FROM f WHERE row <= 17 AND col <= 17")
def block_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a 4x4 place around a superblock of 16 was decoded before it: the row above up to the tile's end, and
    the column to the left, but for its corner below."""
    own = _fields(spark, folder, row=(0, 5), col=(5, 5), w=(10, 4), h=(14, 4)).where("row <= 17 and col <= 17")
    y, x = F.col("row") - 1, F.col("col") - 1
    above, left = (y < 0) & (x < F.col("w") + 1), (x < 0) & (y < F.col("h") + 1)
    return own.select("doc_id", y.alias("y"), x.alias("x"), (~((y == 16) & (x == -1)) & (above | left)).alias("decoded"))


@query("d20_lr_units_of_sb", f"{_sql(r=(0, 5), c=(5, 5), u=(10, 2))}, s AS (SELECT doc_id, r * 16 AS r, c * 16 AS c, 64 << u::INT AS unit FROM f) SELECT doc_id, unnest(range((r * 4 + unit - 1) // unit, least(8, ((r + 16) * 4 + unit - 1) // unit))) AS unit_row, unit FROM s")
def lr_units(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of restoration units whose first row of samples is in a superblock: a range join by division."""
    own = _fields(spark, folder, r=(0, 5), u=(10, 2)).select("doc_id", (F.col("r") * 16).alias("r"), fx.shl(F.lit(64).cast("long"), F.col("u")).alias("unit"))
    up = lambda x: fx.idiv(x * 4 + F.col("unit") - 1, F.col("unit"))
    own = own.select("doc_id", "unit", up(F.col("r")).alias("a"), F.least(F.lit(8).cast("long"), up(F.col("r") + 16)).alias("b"))
    return own.where("a < b").select("doc_id", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("unit_row"), "unit")


MV = {"mode": (0, 2), "y": (2, 12), "x": (14, 12)}
_MVS = "mvs AS (SELECT doc_id, mode, y - 2048 AS y, x - 2048 AS x FROM f)"


def _lower_sql(v: str) -> str:
    return f"CASE WHEN mode = 0 THEN {v} WHEN mode = 1 THEN CASE WHEN {v} > 0 THEN ((abs({v}) + 3) >> 3) << 3 ELSE -(((abs({v}) + 3) >> 3) * 8) END WHEN {v} % 2 <> 0 THEN CASE WHEN {v} > 0 THEN {v} - 1 ELSE {v} + 1 END ELSE {v} END"


@query("e2_lower_precision", f"{_sql(**MV)}, {_MVS} SELECT doc_id, {_lower_sql('y')} AS y, {_lower_sql('x')} AS x FROM mvs")
def lower_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors in full precision (0), whole samples (1) or quarter samples (others)."""
    own = _fields(spark, folder, **MV)
    m = F.col("mode")

    def lower(v):
        whole = fx.shr(F.abs(v) + 3, 3) * 8
        odd = F.when(v % 2 != 0, F.when(v > 0, v - 1).otherwise(v + 1)).otherwise(v)
        return F.when(m == 0, v).when(m == 1, F.when(v > 0, whole).otherwise(-whole)).otherwise(odd)

    return own.select("doc_id", lower(F.col("y") - 2048).alias("y"), lower(F.col("x") - 2048).alias("x"))


@query("e10_projection", f"{_sql(y=(0, 12), num=(12, 6), den=(18, 5))}, p AS (SELECT doc_id, y - 2048 AS mv, greatest(-31, least(31, num - 32)) AS num, least(31, den + 1) AS den FROM f), s AS (SELECT *, mv * num * (16384 // den) AS v FROM p), r AS (SELECT *, greatest(-16383, least(16383, CASE WHEN v >= 0 THEN (v + 8192) >> 14 ELSE -((-v + 8192) >> 14) END)) AS proj FROM s) SELECT doc_id, proj, CASE WHEN proj >= 0 THEN proj >> 6 ELSE -((-proj) >> 6) END AS shift FROM r")
def projection(spark: SparkSession, folder: str) -> DataFrame:
    """A vector scaled by num / den in 14-bit fixed point, and the 8x8 blocks that it moves by."""
    own = _fields(spark, folder, y=(0, 12), num=(12, 6), den=(18, 5))
    num = fx.clip3(F.lit(-31).cast("long"), F.lit(31).cast("long"), F.col("num") - 32)
    den = F.least(F.lit(31).cast("long"), F.col("den") + 1)
    own = own.withColumn("proj", fx.clip3(F.lit(-16383).cast("long"), F.lit(16383).cast("long"), fx.round2_signed((F.col("y") - 2048) * num * fx.idiv(F.lit(16384), den), 14)))
    return own.select("doc_id", "proj", F.when(F.col("proj") >= 0, fx.shr(F.col("proj"), 6)).otherwise(-fx.shr(-F.col("proj"), 6)).alias("shift"))


STORED = {"r0": (0, 3), "r1": (3, 3), "y0": (6, 14), "x0": (20, 14), "y1": (34, 14), "x1": (48, 14)}
_KEEP = "CASE WHEN r{k} BETWEEN 1 AND 4 AND abs(y{k} - 8192) <= 4095 AND abs(x{k} - 8192) <= 4095 THEN "


@query("e11_mv_storage", f"{_sql(**STORED)} SELECT doc_id, coalesce({_KEEP.format(k=1)} r1 END, {_KEEP.format(k=0)} r0 END) AS ref, coalesce({_KEEP.format(k=1)} y1 - 8192 END, {_KEEP.format(k=0)} y0 - 8192 END) AS y, coalesce({_KEEP.format(k=1)} x1 - 8192 END, {_KEEP.format(k=0)} x0 - 8192 END) AS x FROM f")
def mv_storage(spark: SparkSession, folder: str) -> DataFrame:
    """What a block leaves for later frames: the later list's vector to a past frame, unless it is too long, else the earlier one's."""
    own = _fields(spark, folder, **STORED)

    def kept(k, value):
        fits = F.col(f"r{k}").between(1, 4) & (F.abs(F.col(f"y{k}") - 8192) <= 4095) & (F.abs(F.col(f"x{k}") - 8192) <= 4095)
        return F.when(fits, value)

    pick = lambda f: F.coalesce(kept(1, f(1)), kept(0, f(0)))
    return own.select("doc_id", pick(lambda k: F.col(f"r{k}")).alias("ref"), pick(lambda k: F.col(f"y{k}") - 8192).alias("y"), pick(lambda k: F.col(f"x{k}") - 8192).alias("x"))


@query("e9_motion_field", f"{_sql(src=(0, 2), pos=(2, 6), shift=(8, 4), mv=(12, 10))}, p AS (SELECT doc_id, doc_id // 64 AS frame, src, pos, pos + shift - 8 AS place, mv FROM f) SELECT frame, place, arg_max(mv, (src, pos, doc_id)) AS mv FROM p WHERE place BETWEEN 0 AND 63 AND place >= (pos // 8) * 8 - 8 AND place < (pos // 8) * 8 + 16 GROUP BY ALL")
def motion_field(spark: SparkSession, folder: str) -> DataFrame:
    """Projections of up to four references onto a frame's blocks; the last writer of a place stays."""
    own = _fields(spark, folder, src=(0, 2), pos=(2, 6), shift=(8, 4), mv=(12, 10)).select(F.expr("doc_id div 64").alias("frame"), "doc_id", "src", "pos", (F.col("pos") + F.col("shift") - 8).alias("place"), "mv")
    base = fx.shl(fx.shr(F.col("pos"), 3), 3)
    valid = own.where(F.col("place").between(0, 63) & (F.col("place") >= base - 8) & (F.col("place") < base + 16))
    return valid.groupBy("frame", "place").agg(F.max_by("mv", F.struct("src", "pos", "doc_id")).alias("mv"))


@query("i2_lfsr16", f"{WITH}, s AS (SELECT doc_id, {_hex(0, 16)} AS r FROM digests), t AS (SELECT doc_id, r, (xor(xor(r, r >> 1), xor(r >> 3, r >> 12)) & 1) AS b FROM s) SELECT doc_id, (r >> 1) + (b << 15) AS state, ((r >> 1) + (b << 15)) >> 8 AS top8 FROM t")
def lfsr16(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder).select("doc_id", bits.lfsr16(bits.f(F.col("data"), 0, 16), 1)[0].alias("state"))
    return own.select("doc_id", "state", fx.shr(F.col("state"), 8).alias("top8"))


LEVEL = {"base": (0, 6), "seg": (6, 5), "delta": (11, 4), "inter": (15, 1), "sharp": (16, 3)}


@query("h3_filter_strength", f"{_sql(**LEVEL)}, a AS (SELECT doc_id, greatest(0, least(63, base + seg - 16)) AS l, delta - 8 AS d, inter, sharp FROM f), b AS (SELECT *, greatest(0, least(63, l + CASE WHEN inter = 1 THEN d * (1 << (l >> 5)::INT) ELSE 1 << (l >> 5)::INT END)) AS lvl FROM a), c AS (SELECT *, CASE WHEN sharp > 4 THEN 2 WHEN sharp > 0 THEN 1 ELSE 0 END AS s FROM b), e AS (SELECT *, CASE WHEN sharp > 0 THEN greatest(1, least(9 - sharp, lvl >> s)) ELSE greatest(1, lvl >> s) END AS lim FROM c) SELECT doc_id, lvl, lim, 2 * (lvl + 2) + lim AS blimit, lvl >> 4 AS thresh FROM e")
def filter_strength(spark: SparkSession, folder: str) -> DataFrame:
    """Level from the base, a segment's and a reference's delta; sharpness bounds the limits."""
    own = _fields(spark, folder, **LEVEL)
    cap = lambda x: fx.clip3(F.lit(0).cast("long"), F.lit(63).cast("long"), x)
    own = own.withColumn("l", cap(F.col("base") + F.col("seg") - 16))
    step = fx.shl(F.lit(1).cast("long"), fx.shr(F.col("l"), 5))
    own = own.withColumn("lvl", cap(F.col("l") + F.when(F.col("inter") == 1, (F.col("delta") - 8) * step).otherwise(step)))
    low = fx.shr(F.col("lvl"), F.when(F.col("sharp") > 4, 2).when(F.col("sharp") > 0, 1).otherwise(0))
    one = F.lit(1).cast("long")
    own = own.withColumn("lim", F.when(F.col("sharp") > 0, F.greatest(one, F.least(9 - F.col("sharp"), low))).otherwise(F.greatest(one, low)))
    return own.select("doc_id", "lvl", "lim", (2 * (F.col("lvl") + 2) + F.col("lim")).alias("blimit"), fx.shr(F.col("lvl"), 4).alias("thresh"))


_WARP = {"a": (0, 10), "b": (10, 10), "c": (20, 16), "d": (36, 16), "x": (52, 8), "y": (60, 8), "hp": (68, 1), "kind": (69, 2)}
_SIGNED = lambda v, n: f"({v} - {1 << n - 1})"
_ROUNDED = lambda v: f"CASE WHEN hp = 1 THEN sign({v}) * ((abs({v}) + 4096) >> 13) ELSE sign({v}) * ((abs({v}) + 8192) >> 14) * 2 END"


@query("e2_global_vector", f"{_sql(**_WARP)}, g AS (SELECT doc_id, hp, kind, (a - 512) * 8 AS p2, (b - 512) * 8 AS p3, c - 32768 AS p0, d - 32768 AS p1, x * 8 + 3 AS x, y * 8 + 3 AS y FROM f), v AS (SELECT doc_id, hp, kind, p0, p1, p2 * x + p3 * y + p0 AS xc, -p3 * x + p2 * y + p1 AS yc FROM g), m AS (SELECT doc_id, hp, kind, CAST(CASE kind WHEN 0 THEN 0 WHEN 1 THEN p0 >> 13 ELSE {_ROUNDED('yc')} END AS BIGINT) AS r, CAST(CASE kind WHEN 0 THEN 0 WHEN 1 THEN p1 >> 13 ELSE {_ROUNDED('xc')} END AS BIGINT) AS c FROM v) SELECT doc_id, CASE WHEN hp = 1 OR r % 2 = 0 THEN r ELSE r - CAST(sign(r) AS BIGINT) END AS row_, CASE WHEN hp = 1 OR c % 2 = 0 THEN c ELSE c - CAST(sign(c) AS BIGINT) END AS col FROM m")
def global_vector(spark: SparkSession, folder: str) -> DataFrame:
    """A block's vector under a frame's motion: none, a shift, or a rotation and zoom at the block's middle, in eighths or quarters of a sample."""
    own = _fields(spark, folder, **_WARP)
    x, y = F.col("x") * 8 + 3, F.col("y") * 8 + 3
    p0, p1, p2, p3 = F.col("c") - 32768, F.col("d") - 32768, (F.col("a") - 512) * 8, (F.col("b") - 512) * 8
    fine = F.col("hp") == 1
    rounded = lambda v: F.when(fine, fx.round2_signed(v, 13)).otherwise(fx.round2_signed(v, 14) * 2)
    part = lambda shift, v: F.when(F.col("kind") == 0, F.lit(0).cast("long")).when(F.col("kind") == 1, fx.shr(shift, 13)).otherwise(rounded(v))
    own = own.select("doc_id", "hp", part(p0, -p3 * x + p2 * y + p1).alias("r"), part(p1, p2 * x + p3 * y + p0).alias("c"))
    coarse = lambda c: F.when((F.col("hp") == 1) | (F.col(c) % 2 == 0), F.col(c)).otherwise(F.col(c) - F.signum(c).cast("long"))
    return own.select("doc_id", coarse("r").alias("row_"), coarse("c").alias("col"))
