"""Entropy coding round trips (C, A22), measurement (M), schedules and presets (K23-K25), execution (O)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tessera.functions import adapters as A
from tessera.operators import blocks as B, coder, presets, quality
from tessera.plans.containers import RDPOINTS, rd_points
from tessera.plans.registry import query

N = len(A.KINDS)


def _coded(spark: SparkSession, folder: str) -> DataFrame:
    return coder.encode_streams(A.symbols(spark, folder), "user_id", "event_id", "symbol", N)


@query("c1_symbol_decode", f"WITH {A.SYMBOLS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, symbol FROM symbols")
def symbol_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Streams encoded and decoded again: the symbols that went in."""
    return coder.decode_streams(_coded(spark, folder), "user_id", N).select("user_id", "place", "symbol")


@query("c3_symbol_encode", f"WITH {A.SYMBOLS} SELECT user_id, count(*) AS symbols, true AS shorter FROM symbols GROUP BY user_id")
def symbol_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a stream takes less than three bits a symbol and two bytes (five symbols would need three in fixed length)."""
    return _coded(spark, folder).select("user_id", "symbols", (8 * F.octet_length("data") <= 3 * F.col("symbols") + 16).alias("shorter"))


@query("c7_trailing_ok", f"WITH {A.SYMBOLS} SELECT DISTINCT user_id, true AS closed, false AS closed_and_more, false AS cut FROM symbols")
def trailing_ok(spark: SparkSession, folder: str) -> DataFrame:
    """Whether streams end as they should: as they are, with a byte more that is not empty, and without their last byte."""
    own = _coded(spark, folder)
    kinds = {"closed": F.col("data"), "closed_and_more": F.concat("data", F.lit(b"\x80")), "cut": F.expr("substring(data, 1, octet_length(data) - 1)")}
    found = None
    for name, data in kinds.items():
        one = coder.decode_streams(own.withColumn("data", data), "user_id", N).groupBy("user_id").agg(F.bool_and("closed").alias(name))
        found = one if found is None else found.join(one, "user_id")
    return found


def _literals(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, number: numbers below 1000, coded as raw bits and below their bound, and read back."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                writer = coder.Encoder()
                writer.literal(v, 10)
                writer.below(v, 1000)
                reader = coder.Decoder(writer.finish())
                out.append((reader.literal(10), reader.below(1000)))
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["event_id", "raw", "bounded"])

    return A.ratelog(spark, folder).select("event_id", (F.col("bits") % 1000).alias("v")).mapInArrow(run, "event_id long, raw long, bounded long")


@query("c2_bool_decode", f"WITH {A.RATELOG} SELECT event_id, bits % 1000 AS raw FROM ratelog")
def bool_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Equiprobable bits, ten a number."""
    return _literals(spark, folder).select("event_id", "raw")


@query("a22_symbol_literals", f"WITH {A.RATELOG} SELECT event_id, bits % 1000 AS bounded FROM ratelog")
def symbol_literals(spark: SparkSession, folder: str) -> DataFrame:
    return _literals(spark, folder).select("event_id", "bounded")


@query("m1_psnr", f"WITH {A.PAIRS} SELECT frame, round(10 * log10(255.0 * 255.0 / greatest(CAST(sum((s - r) * (s - r)) AS DOUBLE) / count(*), 1e-10)), 6) AS psnr FROM pairs GROUP BY frame")
def psnr(spark: SparkSession, folder: str) -> DataFrame:
    own = A.pairs(spark, folder).groupBy("frame").agg(F.sum(B.sse(F.col("v"), F.col("ref"))).alias("e"), (F.count("*") * 64).alias("n"))
    return own.select("frame", F.round(quality.psnr(F.col("e"), F.col("n")), 6).alias("psnr"))


@query("m2_psnr_yuv", f"WITH {RDPOINTS} SELECT clip, q, round((6 * psnr + (psnr + 2) + (psnr - 1)) / 8, 6) AS yuv FROM rd")
def psnr_yuv(spark: SparkSession, folder: str) -> DataFrame:
    own = rd_points(spark, folder)
    return own.select("clip", "q", F.round(quality.psnr_yuv(F.col("psnr"), F.col("psnr") + 2, F.col("psnr") - 1), 6).alias("yuv"))


_POWERS = ", ".join(f"round(sum(pow(psnr - 40, {k})), 4) AS x{k}" for k in range(7))


@query("m3_cubic_moments", f"WITH {RDPOINTS} SELECT clip, {_POWERS} FROM rd GROUP BY clip")
def cubic_moments(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of powers that the normal equations of a cubic are made of."""
    own = rd_points(spark, folder)
    return own.groupBy("clip").agg(*[F.round(F.sum(F.pow(F.col("psnr") - 40, F.lit(k))), 4).alias(f"x{k}") for k in range(7)])


@query("m3_cubic_fit")
def cubic_fit(spark: SparkSession, folder: str) -> DataFrame:
    return quality.cubic_fits(rd_points(spark, folder))


def _two(spark: SparkSession, folder: str) -> DataFrame:
    """Points of two encoders: the second one takes two per cent more bytes for each decibel above 40, in logarithms, and less below."""
    own = rd_points(spark, folder).where("bytes > 0")
    more = own.withColumn("bytes", F.col("bytes") * F.exp(0.02 * (F.col("psnr") - 40)))
    return own.withColumn("encoder", F.lit("base")).unionByName(more.withColumn("encoder", F.lit("test")))


@query("m4_bd_rate", f"WITH {RDPOINTS} SELECT clip, round((exp(0.02 * ((min(psnr) + max(psnr)) / 2 - 40)) - 1) * 100, 3) AS bd_rate FROM rd WHERE bytes > 0 GROUP BY clip HAVING count(*) >= 4")
def bd_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The curves differ by a straight line in logarithms, whose mean over the common range is its middle."""
    return quality.bd_rates(_two(spark, folder)).select("clip", F.round("bd_rate", 3).alias("bd_rate"))


@query("m5_rd_report", f"WITH {RDPOINTS} SELECT clip, count(*) AS points, CAST(sum(bytes) AS BIGINT) AS bytes, round(avg(psnr), 4) AS psnr FROM rd GROUP BY ROLLUP (clip)")
def rd_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per clip and over all, in one pass."""
    return rd_points(spark, folder).rollup("clip").agg(F.count("*").alias("points"), F.sum("bytes").alias("bytes"), F.round(F.avg("psnr"), 4).alias("psnr"))


@query("m6_bitrate_accuracy", f"WITH {A.RATELOG} SELECT user_id, round(CAST(sum(bits) AS DOUBLE) / (count(*) * 2500.0) - 1, 6) AS accuracy FROM ratelog GROUP BY user_id")
def bitrate_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return A.ratelog(spark, folder).groupBy("user_id").agg(F.round(F.sum("bits").cast("double") / (F.count("*") * 2500.0) - 1, 6).alias("accuracy"))


@query("m7_throughput", f"WITH {A.RATELOG} SELECT user_id, min(bits + 1) AS best, round(max(3200.0 / (bits + 1)), 6) AS rate FROM ratelog GROUP BY user_id")
def throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Best of n runs: least time and highest rate."""
    return A.ratelog(spark, folder).groupBy("user_id").agg(F.min(F.col("bits") + 1).alias("best"), F.round(F.max(3200.0 / (F.col("bits") + 1)), 6).alias("rate"))


VERDICT = f"WITH {A.OBUS}, e AS (SELECT conv_id, turn, md5(payload) AS d FROM obus WHERE turn % 7 <> 5), g AS (SELECT conv_id, turn, md5(payload || CASE WHEN turn % 5 = 4 THEN 'x' ELSE '' END) AS d FROM obus WHERE turn % 6 <> 5)"


@query("m8_vector_verdict", f"{VERDICT} SELECT conv_id, count(g_d) AS frames, count(e_d) AS expected, count(*) FILTER (g_d = e_d) AS matched, min(turn) FILTER (g_d IS DISTINCT FROM e_d) AS first_failure FROM (SELECT coalesce(e.conv_id, g.conv_id) AS conv_id, coalesce(e.turn, g.turn) AS turn, e.d AS e_d, g.d AS g_d FROM e FULL JOIN g ON e.conv_id = g.conv_id AND e.turn = g.turn) GROUP BY conv_id")
def vector_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Digests found against those expected, where either side may lack frames."""
    own = A.obus(spark, folder)
    expected = own.where("turn % 7 <> 5").select("conv_id", "turn", F.md5("payload").alias("expected"))
    wrong = F.when(F.col("turn") % 5 == 4, F.lit(b"x")).otherwise(F.lit(b""))
    found = own.where("turn % 6 <> 5").select("conv_id", "turn", F.md5(F.concat("payload", wrong)).alias("found"))
    return quality.verdicts(expected, found, "conv_id", "turn")


@query("m9_clip_generators", "SELECT CAST(range AS BIGINT) AS n, CASE WHEN range % 18 < 10 THEN range % 18 ELSE 18 - range % 18 END AS pingpong, CASE WHEN (range * 7) % 158 < 80 THEN (range * 7) % 158 ELSE 158 - (range * 7) % 158 END AS pan, range % 40 = 0 AND range > 0 AS scene_cut FROM range(200)")
def clip_generators(spark: SparkSession, folder: str) -> DataFrame:
    """Frame numbers to and fro over ten frames, a mirrored pan over 80 columns, and scene cuts."""
    mirrored = lambda v, top: F.when(v % (2 * top - 2) < top, v % (2 * top - 2)).otherwise(2 * top - 2 - v % (2 * top - 2))
    own = spark.range(200).withColumnRenamed("id", "n")
    return own.select("n", mirrored(F.col("n"), 10).alias("pingpong"), mirrored(F.col("n") * 7, 80).alias("pan"), ((F.col("n") % 40 == 0) & (F.col("n") > 0)).alias("scene_cut"))


_WORD = "4294967295"
_SHIFTED = f"a AS (SELECT n, xor(x, (x << 13) & {_WORD}) AS x FROM {{0}}), {{1}}b AS (SELECT n, xor(x, x >> 17) AS x FROM {{1}}a), {{1}} AS (SELECT n, xor(x, (x << 5) & {_WORD}) AS x FROM {{1}}b)"


@query("m9_noise", f"WITH s AS (SELECT CAST(range AS BIGINT) AS n, (range * 2654435761 + 1) & {_WORD} AS x FROM range(500)), r1{_SHIFTED.format('s', 'r1')}, r2{_SHIFTED.format('r1', 'r2')}, r3{_SHIFTED.format('r2', 'r3')} SELECT n, x, CAST(x >> 24 AS INTEGER) AS sample FROM r3")
def noise(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of noise: three rounds of a 32-bit shift register from a seed of the place."""
    word = F.lit((1 << 32) - 1)

    def round_(x: Column) -> Column:
        x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(word))
        x = x.bitwiseXOR(F.shiftright(x, 17))
        return x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(word))

    own = spark.range(500).select(F.col("id").alias("n"), (F.col("id") * 2654435761 + 1).bitwiseAND(word).alias("x"))
    for _ in range(3):
        own = own.select("n", round_(F.col("x")).alias("x"))
    return own.select("n", "x", F.shiftright("x", 24).cast("int").alias("sample"))


@query("k24_wavefront_level", f'WITH {A.BLOCKS} SELECT blk, bx + 2 * "by" AS level, count(*) OVER (PARTITION BY frame, bx + 2 * "by") AS width FROM blocks')
def wavefront_level(spark: SparkSession, folder: str) -> DataFrame:
    """The step at which a block can be worked on: a row starts two blocks behind the one above."""
    level = F.col("bx") + 2 * F.col("by")
    return A.blocks(spark, folder).select("blk", level.alias("level"), F.count("*").over(Window.partitionBy("frame", level)).alias("width"))


@query("k23_decision_replay", f"WITH {A.PAIRS}, c AS (SELECT blk, CAST(sum(abs(s - r)) AS BIGINT) AS sad FROM pairs GROUP BY blk) SELECT blk, sad, sad < 1500 AS skip, row_number() OVER (PARTITION BY blk // 50 ORDER BY blk) - 1 AS seq FROM c")
def decision_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions made once, written as a log with their order, and joined back to the blocks."""
    from tessera.functions.lineage import cut

    cost = A.pairs(spark, folder).select("blk", "frame", B.sad(F.col("v"), F.col("ref")).alias("sad"))
    log = cut(cost.select("blk", "sad", (F.col("sad") < 1500).alias("skip"), (F.row_number().over(Window.partitionBy("frame").orderBy("blk")) - 1).cast("long").alias("seq")))
    return A.blocks(spark, folder).select("blk").join(log, "blk")


def _presets_sql() -> str:
    steps = lambda v: "CASE " + " ".join(f"WHEN range <= {last} THEN {value}" for last, value in v) + " END"
    columns = [f"range <= {v} AS {k}" for k, v in presets.UNTIL.items()] + [f"range >= {v} AS {k}" for k, v in presets.FROM.items()] + [f"{str(v).lower()} AS {k}" for k, v in presets.ALWAYS.items()]
    return ", ".join(columns + [f"CAST({steps(v)} AS INTEGER) AS {k}" for k, v in presets.NUMBERS.items()])


@query("k25_speed_presets", f"SELECT CAST(range AS INTEGER) AS speed, {_presets_sql()} FROM range(11)")
def speed_presets(spark: SparkSession, folder: str) -> DataFrame:
    """All 32 switches by speed, as a table to join with."""
    return presets.table(spark)


@query("o1_parallel_map", f"WITH {A.PIXELS} SELECT blk, CAST(sum(s) AS BIGINT) AS total FROM pixels GROUP BY blk")
def parallel_map(spark: SparkSession, folder: str) -> DataFrame:
    """A function of each block, whatever task works on it."""
    return A.blocks(spark, folder).repartition(7).select("blk", B.total(F.col("v")).alias("total"))


@query("o2_tiles_in_parallel", f"WITH {A.PIXELS} SELECT frame, bx // 5 AS tile, count(*) AS samples, CAST(sum(s) AS BIGINT) AS total FROM pixels GROUP BY ALL")
def tiles_in_parallel(spark: SparkSession, folder: str) -> DataFrame:
    """A group a tile, each worked on by itself."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        v = pc.list_flatten(table.column("v").combine_chunks())
        return pa.table({"frame": table.column("frame")[:1], "tile": table.column("tile")[:1], "samples": pa.array([len(v)], pa.int64()), "total": pa.array([pc.sum(v).as_py()], pa.int64())})

    own = A.blocks(spark, folder).select("frame", F.expr("bx div 5").alias("tile"), "v")
    return own.groupBy("frame", "tile").applyInArrow(run, "frame long, tile long, samples long, total long")


@query("o3_wavefront_schedule", f'WITH {A.BLOCKS} SELECT frame, bx + 2 * "by" AS level, count(*) AS ready FROM blocks GROUP BY ALL')
def wavefront_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return A.blocks(spark, folder).groupBy("frame", (F.col("bx") + 2 * F.col("by")).alias("level")).agg(F.count("*").alias("ready"))
