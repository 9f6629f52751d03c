"""Bit fields and scalar functions (A14-A21, B13, D6, N1-N11), over digests of whole texts and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import adapters as A, bits, fx
from tessera.plans.registry import query

WITH = f"WITH {A.DIGESTS}"


def _hex(at: int, n: int) -> str:
    """SQL for n bits from bit ``at`` of the digest."""
    first, last = at // 8, (at + n - 1) // 8
    return f"((CAST('0x' || substr(hex, {2 * first + 1}, {2 * (last - first + 1)}) AS BIGINT) >> {(last + 1) * 8 - at - n}) & {(1 << n) - 1})"


FIELDS = ((0, 1), (1, 4), (5, 13), (18, 32), (50, 7), (120, 8))


@query("a14_bit_f", f"{WITH} SELECT doc_id, {', '.join(f'{_hex(a, n)} AS f{a}_{n}' for a, n in FIELDS)}, CAST(NULL AS BIGINT) AS beyond FROM digests")
def bit_f(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder)
    return own.select("doc_id", *[bits.f(F.col("data"), a, n).alias(f"f{a}_{n}") for a, n in FIELDS], bits.f(F.col("data"), 125, 4).alias("beyond"))


@query("a15_bit_su", f"{WITH}, v AS (SELECT doc_id, {_hex(3, 7)} AS a, {_hex(40, 16)} AS b FROM digests) SELECT doc_id, CASE WHEN a & 64 <> 0 THEN a - 128 ELSE a END AS su7, CASE WHEN b & 32768 <> 0 THEN b - 65536 ELSE b END AS su16 FROM v")
def bit_su(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder)
    return own.select("doc_id", bits.su(F.col("data"), 3, 7).alias("su7"), bits.su(F.col("data"), 40, 16).alias("su16"))


def _ns_sql(at: int, n: int) -> str:
    w = n.bit_length()
    v = _hex(at, w - 1)
    return f"CASE WHEN {v} < {(1 << w) - n} THEN {v} ELSE ({v} << 1) - {(1 << w) - n} + {_hex(at + w - 1, 1)} END"


@query("a16_bit_ns", f"{WITH} SELECT doc_id, {_ns_sql(2, 5)} AS ns5, {_ns_sql(9, 100)} AS ns100, {_ns_sql(30, 1000)} AS ns1000 FROM digests")
def bit_ns(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder)
    return own.select("doc_id", *[bits.ns(F.col("data"), at, n).alias(f"ns{n}") for at, n in ((2, 5), (9, 100), (30, 1000))])


@query(
    "a17_bit_uvlc",
    f"""{WITH}, b AS (SELECT doc_id, list_reduce(list_transform(range(1, 17), lambda k: lpad(bin(CAST('0x' || substr(hex, CAST(k AS BIGINT), 1) AS BIGINT)), 4, '0')), lambda x, y: x || y) AS bits FROM digests),
z AS (SELECT doc_id, bits, strpos(bits, '1') - 1 AS zeros FROM b)
SELECT doc_id, CASE WHEN zeros < 0 OR zeros > 40 THEN NULL WHEN zeros >= 32 THEN 4294967295 WHEN zeros = 0 THEN 0
ELSE (1 << zeros) - 1 + list_reduce(list_transform(range(1, zeros + 1), lambda k: CAST(substr(bits, zeros + 1 + k, 1) AS BIGINT)), lambda x, y: 2 * x + y) END AS uvlc FROM z""",
)
def bit_uvlc(spark: SparkSession, folder: str) -> DataFrame:
    return A.digests(spark, folder).select("doc_id", bits.uvlc(F.col("data")).alias("uvlc"))


_BYTE = [f"CAST('0x' || substr(hex, {2 * k + 1}, 2) AS BIGINT)" for k in range(8)]
_ENDS = " ".join(f"WHEN {_BYTE[k]} < 128 THEN {k + 1}" for k in range(8))
_SUM = " + ".join(f"CASE WHEN size > {k} THEN ({_BYTE[k]} & 127) << {7 * k} ELSE 0 END" for k in range(8))


@query("a18_leb128_read", f"{WITH}, s AS (SELECT doc_id, hex, CASE {_ENDS} END AS size FROM digests) SELECT doc_id, CASE WHEN size IS NOT NULL THEN {_SUM} END AS value, size FROM s")
def leb128_read(spark: SparkSession, folder: str) -> DataFrame:
    read = bits.leb128(F.col("data"))
    return A.digests(spark, folder).select("doc_id", read["value"].alias("value"), read["size"].alias("size"))


_VALUE = _hex(0, 32)
_PART = [f"lpad(to_hex(((v >> {7 * k}) & 127) + CASE WHEN v >= {1 << (7 * (k + 1))} THEN 128 ELSE 0 END), 2, '0')" for k in range(5)]
_CODE = " || ".join([_PART[0], *[f"CASE WHEN v >= {1 << (7 * k)} THEN {_PART[k]} ELSE '' END" for k in range(1, 5)]])


@query("a19_leb128_write", f"{WITH}, n AS (SELECT doc_id, {_VALUE} >> CAST(doc_id % 30 AS INTEGER) AS v FROM digests) SELECT doc_id, v AS value, upper({_CODE}) AS code, v AS back FROM n")
def leb128_write(spark: SparkSession, folder: str) -> DataFrame:
    value = fx.shr(bits.f(F.col("data"), 0, 32), F.pmod("doc_id", F.lit(30)))
    own = A.digests(spark, folder).select("doc_id", value.alias("value")).withColumn("octets", bits.leb128_bytes(F.col("value")))
    return own.select("doc_id", "value", F.hex("octets").alias("code"), bits.leb128(F.col("octets"))["value"].alias("back"))


@query(
    "a20_bit_writer",
    f"""{WITH}, v AS (SELECT doc_id, {_hex(0, 4)} AS a, {_hex(4, 11)} AS b, {_hex(15, 1)} AS c FROM digests),
w AS (SELECT doc_id, lpad(bin(a), 4, '0') || lpad(bin(b), 11, '0') || lpad(bin(c), 1, '0') || '10000000' AS bits FROM v)
SELECT doc_id, upper(list_reduce(list_transform(range(0, 6), lambda k: to_hex(list_reduce(list_transform(range(1, 5), lambda m: CAST(substr(bits, 4 * k + m, 1) AS BIGINT)), lambda x, y: 2 * x + y))), lambda x, y: x || y)) AS code FROM w""",
)
def bit_writer(spark: SparkSession, folder: str) -> DataFrame:
    field = lambda at, n: F.struct(F.lit(n).alias("n"), bits.f(F.col("data"), at, n).alias("v"))
    return A.digests(spark, folder).select("doc_id", F.hex(bits.packed(F.array(field(0, 4), field(4, 11), field(15, 1)))).alias("code"))


@query("a21_inverse_recenter", f"{WITH}, n AS (SELECT doc_id, {_hex(0, 5)} AS r, {_hex(8, 7)} AS v FROM digests) SELECT doc_id, r, v, CASE WHEN v > 2 * r THEN v WHEN v % 2 = 1 THEN r - (v + 1) // 2 ELSE r + v // 2 END AS x FROM n")
def inverse_recenter(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder).select("doc_id", bits.f(F.col("data"), 0, 5).alias("r"), bits.f(F.col("data"), 8, 7).alias("v"))
    return own.withColumn("x", fx.inverse_recenter(F.col("r"), F.col("v")))


@query("b13_relative_dist", f"{WITH}, n AS (SELECT doc_id, {_hex(0, 7)} AS a, {_hex(8, 7)} AS b FROM digests) SELECT doc_id, a, b, ((a - b) & 63) - ((a - b) & 64) AS d FROM n")
def relative_dist(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder).select("doc_id", bits.f(F.col("data"), 0, 7).alias("a"), bits.f(F.col("data"), 8, 7).alias("b"))
    return own.withColumn("d", fx.relative_distance(F.col("a"), F.col("b"), 7))


@query(
    "d6_neg_deinterleave",
    f"""{WITH}, n AS (SELECT doc_id, {_hex(0, 3)} AS diff, {_hex(3, 3)} AS ref FROM digests),
m AS (SELECT *, CASE WHEN diff % 2 = 1 THEN ref + (diff + 1) // 2 ELSE ref - diff // 2 END AS near FROM n)
SELECT doc_id, diff, ref, CASE WHEN ref = 0 THEN diff WHEN ref >= 7 THEN 8 - diff - 1 WHEN 2 * ref < 8 THEN CASE WHEN diff <= 2 * ref THEN near ELSE diff END ELSE CASE WHEN diff <= 2 * (8 - ref - 1) THEN near ELSE 8 - (diff + 1) END END AS id FROM m""",
)
def neg_deinterleave(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder).select("doc_id", bits.f(F.col("data"), 0, 3).alias("diff"), bits.f(F.col("data"), 3, 3).alias("ref"))
    return own.withColumn("id", fx.neg_deinterleave(F.col("diff"), F.col("ref"), F.lit(8)))


def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    """x: signed 20 bits, n: 0 to 7."""
    return A.digests(spark, folder).select("doc_id", bits.su(F.col("data"), 0, 20).alias("x"), bits.f(F.col("data"), 20, 3).alias("n"))


NUMBERS = f"{WITH}, u AS (SELECT doc_id, {_hex(0, 20)} AS u, {_hex(20, 3)} AS n FROM digests), num AS (SELECT doc_id, CASE WHEN u >= 524288 THEN u - 1048576 ELSE u END AS x, n FROM u)"
_R2 = "CASE WHEN n = 0 THEN {x} ELSE ({x} + (1 << greatest(CAST(n AS INTEGER) - 1, 0))) >> CAST(n AS INTEGER) END"


@query("n1_round2", f"{NUMBERS} SELECT doc_id, x, n, {_R2.format(x='x')} AS y FROM num")
def round2(spark: SparkSession, folder: str) -> DataFrame:
    return _numbers(spark, folder).withColumn("y", fx.round2(F.col("x"), F.col("n")))


@query("n2_round2_signed", f"{NUMBERS} SELECT doc_id, x, n, CASE WHEN x >= 0 THEN {_R2.format(x='x')} ELSE -({_R2.format(x='(-x)')}) END AS y FROM num")
def round2_signed(spark: SparkSession, folder: str) -> DataFrame:
    return _numbers(spark, folder).withColumn("y", fx.round2_signed(F.col("x"), F.col("n")))


@query("n3_clip3", f"{NUMBERS} SELECT doc_id, greatest(-1000, least(1000, x)) AS y FROM num")
def clip3(spark: SparkSession, folder: str) -> DataFrame:
    return _numbers(spark, folder).select("doc_id", fx.clip3(F.lit(-1000).cast("long"), F.lit(1000).cast("long"), F.col("x")).alias("y"))


@query("n4_log2", f"{NUMBERS} SELECT doc_id, length(bin(abs(x) + 1)) - 1 AS floor_log2, CASE WHEN abs(x) + 1 < 2 THEN 0 ELSE length(bin(abs(x))) END AS ceil_log2 FROM num")
def log2(spark: SparkSession, folder: str) -> DataFrame:
    x = F.abs("x") + 1
    return _numbers(spark, folder).select("doc_id", fx.floor_log2(x).cast("long").alias("floor_log2"), fx.ceil_log2(x).cast("long").alias("ceil_log2"))


@query("n5_block_size", f"{WITH}, n AS (SELECT doc_id, {_hex(0, 3)} AS w, {_hex(3, 3)} AS h FROM digests) SELECT doc_id, 4 << CAST(w % 6 AS INTEGER) AS width, 4 << CAST(h % 6 AS INTEGER) AS height, (4 << CAST(w % 6 AS INTEGER)) // 4 AS num4x4_w FROM n")
def block_size(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes from their logarithms, which the caller's table of block sizes would hold."""
    size = lambda at: fx.shl(F.lit(4).cast("long"), bits.f(F.col("data"), at, 3) % 6)
    return A.digests(spark, folder).select("doc_id", size(0).alias("width"), size(3).alias("height"), fx.shr(size(0), 2).alias("num4x4_w"))


@query(
    "n6_constrain",
    f"""{WITH}, n AS (SELECT doc_id, CAST({_hex(0, 9)} AS BIGINT) - 256 AS diff, {_hex(9, 4)} AS strength, {_hex(13, 2)} + 3 AS damping FROM digests),
m AS (SELECT *, CASE WHEN strength = 0 THEN 0 ELSE least(abs(diff), greatest(0, strength - (abs(diff) >> CAST(greatest(0, damping - (length(bin(greatest(strength, 1))) - 1)) AS INTEGER)))) END AS size FROM n)
SELECT doc_id, diff, strength, damping, CAST(CASE WHEN diff < 0 THEN -size ELSE size END AS BIGINT) AS y FROM m""",
)
def constrain(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder).select("doc_id", (bits.f(F.col("data"), 0, 9) - 256).alias("diff"), bits.f(F.col("data"), 9, 4).alias("strength"), (bits.f(F.col("data"), 13, 2) + 3).alias("damping"))
    return own.withColumn("y", fx.constrain(F.col("diff"), F.col("strength"), F.col("damping")))


@query("n7_units_in_frame", f"{WITH}, n AS (SELECT doc_id, {_hex(0, 13)} AS size, 64 << CAST({_hex(13, 2)} AS INTEGER) AS unit FROM digests) SELECT doc_id, size, unit, greatest((size + unit // 2) // unit, 1) AS units FROM n")
def units_in_frame(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder).select("doc_id", bits.f(F.col("data"), 0, 13).alias("size"), fx.shl(F.lit(64).cast("long"), bits.f(F.col("data"), 13, 2)).alias("unit"))
    return own.withColumn("units", fx.units_in_frame(F.col("unit"), F.col("size")))


_TURNED = " + ".join(f"(((x >> {k}) & 1) << {7 - k})" for k in range(8))


@query("n8_brev_cos", f"{WITH}, n AS (SELECT doc_id, {_hex(0, 8)} AS x FROM digests) SELECT doc_id, x, {_TURNED} AS turned, CAST(round(cos(x * pi() / 128), 6) + 0.0 AS DOUBLE) AS cos128, CAST(round(sin(x * pi() / 128), 6) + 0.0 AS DOUBLE) AS sin128 FROM n")
def brev_cos(spark: SparkSession, folder: str) -> DataFrame:
    """Bit reversal, and the angle functions as real numbers (the fixed-point tables are not part of this library)."""
    own = A.digests(spark, folder).select("doc_id", bits.f(F.col("data"), 0, 8).alias("x"))
    angle = F.col("x") * F.pi() / 128
    return own.select("doc_id", "x", fx.reverse_bits(F.col("x"), 8).alias("turned"), (F.round(F.cos(angle), 6) + 0.0).alias("cos128"), (F.round(F.sin(angle), 6) + 0.0).alias("sin128"))


@query(
    "n9_plane_geometry",
    f"""{WITH}, n AS (SELECT doc_id, {_hex(0, 12)} + 1 AS w, {_hex(12, 12)} + 1 AS h, {_hex(24, 2)} AS format FROM digests),
s AS (SELECT *, CASE WHEN format IN (1, 2) THEN 1 ELSE 0 END AS ssx, CASE WHEN format = 1 THEN 1 ELSE 0 END AS ssy FROM n),
c AS (SELECT *, CASE WHEN format = 0 THEN 0 ELSE (w + ssx) >> ssx END AS cw, CASE WHEN format = 0 THEN 0 ELSE (h + ssy) >> ssy END AS ch FROM s)
SELECT doc_id, format, w, h, cw, ch, w * h AS u_at, w * h + cw * ch AS v_at, w * h + 2 * cw * ch AS size FROM c""",
)
def plane_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """Chroma sizes and plane offsets for monochrome (0), 4:2:0 (1), 4:2:2 (2) and 4:4:4 (3)."""
    own = A.digests(spark, folder).select("doc_id", (bits.f(F.col("data"), 0, 12) + 1).alias("w"), (bits.f(F.col("data"), 12, 12) + 1).alias("h"), bits.f(F.col("data"), 24, 2).alias("format"))
    ssx, ssy = F.when(F.col("format").isin(1, 2), 1).otherwise(0), F.when(F.col("format") == 1, 1).otherwise(0)
    side = lambda size, ss: F.when(F.col("format") == 0, F.lit(0).cast("long")).otherwise(fx.shr(F.col(size) + ss, ss))
    own = own.select("doc_id", "format", "w", "h", side("w", ssx).alias("cw"), side("h", ssy).alias("ch"))
    luma, chroma = F.col("w") * F.col("h"), F.col("cw") * F.col("ch")
    return own.select("*", luma.alias("u_at"), (luma + chroma).alias("v_at"), (luma + 2 * chroma).alias("size"))


@query("n10_sample_get", f"{WITH} SELECT doc_id, {_hex(24, 8)} AS one_byte, {_hex(32, 8)} + 256 * {_hex(40, 8)} AS two_bytes FROM digests")
def sample_get(spark: SparkSession, folder: str) -> DataFrame:
    """Sample 3 of 8-bit data, and sample 2 of little-endian 16-bit data."""
    data = F.col("data")
    return A.digests(spark, folder).select("doc_id", bits.f(data, 24, 8).alias("one_byte"), (bits.f(data, 32, 8) + 256 * bits.f(data, 40, 8)).alias("two_bytes"))


@query("n11_mode_predicates", f"{WITH}, n AS (SELECT doc_id, {_hex(0, 5)} AS mode FROM digests) SELECT doc_id, mode, mode BETWEEN 1 AND 8 AS directional, mode IN (16, 19, 20, 21, 22, 24) AS has_newmv, mode IN (14, 18, 21, 22) AS has_nearmv, mode BETWEEN 17 AND 24 AS compound FROM n")
def mode_predicates(spark: SparkSession, folder: str) -> DataFrame:
    own = A.digests(spark, folder).select("doc_id", bits.f(F.col("data"), 0, 5).alias("mode"))
    return own.select("doc_id", "mode", F.col("mode").between(1, 8).alias("directional"), F.col("mode").isin(16, 19, 20, 21, 22, 24).alias("has_newmv"), F.col("mode").isin(14, 18, 21, 22).alias("has_nearmv"), F.col("mode").between(17, 24).alias("compound"))
