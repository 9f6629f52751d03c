"""Syntax elements of blocks as expressions (D5-D18, D21), and the dispatch of units (J1), over logs of events and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tessera.functions import adapters as A, fx
from tessera.operators import streams as S
from tessera.plans.registry import query

LOG = f"WITH {A.RATELOG}"
#: Numbers of the single and compound inter modes.
NEAREST, NEAR, GLOBAL, NEW = 13, 14, 15, 16
PAIRS = {17: (NEAREST, NEAREST), 18: (NEAR, NEAR), 19: (NEAREST, NEW), 20: (NEW, NEAREST), 21: (NEAR, NEW), 22: (NEW, NEAR), 23: (GLOBAL, GLOBAL), 24: (NEW, NEW)}


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return A.ratelog(spark, folder)


@query("d5_intra_mode_context", f"{LOG}, m AS (SELECT *, bits % 13 AS mode FROM ratelog) SELECT event_id, mode, coalesce(lag(CASE WHEN mode = 0 OR mode >= 12 THEN 0 WHEN mode IN (1, 8) THEN 1 WHEN mode = 2 THEN 2 WHEN mode IN (3, 7) THEN 3 ELSE 4 END) OVER (PARTITION BY user_id ORDER BY n), 0) AS context FROM m")
def intra_mode_context(spark: SparkSession, folder: str) -> DataFrame:
    """Class of the mode to the left, by a grouping given."""
    mode = F.col("mode")
    kind = F.when((mode == 0) | (mode >= 12), 0).when(mode.isin(1, 8), 1).when(mode == 2, 2).when(mode.isin(3, 7), 3).otherwise(4)
    left = F.lag(kind).over(Window.partitionBy("user_id").orderBy("n"))
    return _log(spark, folder).withColumn("mode", F.col("bits") % 13).select("event_id", "mode", F.coalesce(left, F.lit(0)).alias("context"))


@query("d7_skip_context", f"{LOG}, m AS (SELECT *, (bits % 3 = 0)::INT AS skip FROM ratelog) SELECT event_id, coalesce(lag(skip, 1) OVER w, 0) + coalesce(lag(skip, 4) OVER w, 0) AS context FROM m WINDOW w AS (PARTITION BY user_id ORDER BY n)")
def skip_context(spark: SparkSession, folder: str) -> DataFrame:
    """Skipped neighbours: the block before, and the one a row of four before."""
    order = Window.partitionBy("user_id").orderBy("n")
    skip = F.when(F.col("bits") % 3 == 0, 1).otherwise(0)
    before = lambda k: F.coalesce(F.lag(skip, k).over(order), F.lit(0))
    return _log(spark, folder).select("event_id", (before(1) + before(4)).alias("context"))


@query("d8_delta_q", f"WITH RECURSIVE {A.RATELOG}, q AS (SELECT user_id, CAST(-1 AS BIGINT) AS n, CAST(100 AS BIGINT) AS q FROM (SELECT DISTINCT user_id FROM ratelog) UNION ALL SELECT q.user_id, r.n, greatest(1, least(255, q.q + (r.bits % 9 - 4) * 8)) FROM q JOIN ratelog r ON r.user_id = q.user_id AND r.n = q.n + 1) SELECT user_id, arg_max(q, n) AS q FROM q GROUP BY user_id")
def delta_q(spark: SparkSession, folder: str) -> DataFrame:
    """The quantiser after all deltas of a stream, clamped at each step."""
    rows = S.ordered(_log(spark, folder).withColumn("d", (F.col("bits") % 9 - 4) * 8), "user_id", "n", "d")
    last = F.aggregate("rows", F.lit(100).cast("long"), lambda q, r: fx.clip3(F.lit(1).cast("long"), F.lit(255).cast("long"), q + r["d"]))
    return rows.select("user_id", last.alias("q"))


@query("d9_cfl_signs", f"{LOG}, j AS (SELECT event_id, bits % 8 AS js, bits % 16 AS a, bits // 16 % 16 AS b FROM ratelog) SELECT event_id, CASE (js + 1) // 3 WHEN 0 THEN 0 WHEN 1 THEN -(a + 1) ELSE a + 1 END AS u, CASE (js + 1) % 3 WHEN 0 THEN 0 WHEN 1 THEN -(b + 1) ELSE b + 1 END AS v FROM j")
def cfl_signs(spark: SparkSession, folder: str) -> DataFrame:
    """Signed alphas of both chroma planes from a joint sign and their sizes."""
    signed = lambda sign, size: F.when(sign == 0, F.lit(0).cast("long")).when(sign == 1, -(size + 1)).otherwise(size + 1)
    joint = F.col("bits") % 8 + 1
    return _log(spark, folder).select("event_id", signed(fx.idiv(joint, 3), F.col("bits") % 16).alias("u"), signed(joint % 3, fx.idiv(F.col("bits"), 16) % 16).alias("v"))


@query("d10_filter_intra_allowed", f"{LOG} SELECT event_id, bits % 13 = 0 AND bits % 9 = 0 AND greatest(4 << (bits % 5)::INT, 4 << (bits // 5 % 5)::INT) <= 32 AS allowed FROM ratelog")
def filter_intra_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with the mean mode, no palette and sides of 32 at most."""
    side = lambda x: fx.shl(F.lit(4), x % 5)
    bits = F.col("bits")
    return _log(spark, folder).select("event_id", ((bits % 13 == 0) & (bits % 9 == 0) & (F.greatest(side(bits), side(fx.idiv(bits, 5))) <= 32)).alias("allowed"))


@query("d13_var_tx_tree", f"{LOG}, b AS (SELECT event_id, 8 << (bits % 4)::INT AS size, bits // 4 % 4 AS depth FROM ratelog) SELECT event_id, size, greatest(4, size >> least(depth, 2)::INT) AS tx, (size // greatest(4, size >> least(depth, 2)::INT)) * (size // greatest(4, size >> least(depth, 2)::INT)) AS blocks FROM b")
def var_tx_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of a transform tree that splits evenly, twice at most."""
    own = _log(spark, folder).select("event_id", fx.shl(F.lit(8), F.col("bits") % 4).alias("size"), (fx.idiv(F.col("bits"), 4) % 4).alias("depth"))
    tx = F.greatest(F.lit(4), fx.shr(F.col("size"), F.least("depth", F.lit(2).cast("long"))))
    side = fx.idiv(F.col("size"), tx)
    return own.select("event_id", "size", tx.alias("tx"), (side * side).alias("blocks"))


@query("d14_mode_of_list", f"{LOG} SELECT event_id, bits % 12 + 13 AS mode, CASE bits % 12 + 13 {' '.join(f'WHEN {k} THEN {v[0]}' for k, v in PAIRS.items())} ELSE bits % 12 + 13 END AS first, CASE bits % 12 + 13 {' '.join(f'WHEN {k} THEN {v[1]}' for k, v in PAIRS.items())} ELSE bits % 12 + 13 END AS second FROM ratelog")
def mode_of_list(spark: SparkSession, folder: str) -> DataFrame:
    """The single mode that a compound one has for each reference."""
    mode = F.col("bits") % 12 + 13

    def part(k: int) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x).cast("long") for m, p in PAIRS.items() for x in (m, p[k])])[mode], mode)

    return _log(spark, folder).select("event_id", mode.alias("mode"), part(0).alias("first"), part(1).alias("second"))


@query("d16_vector_classes", f"{LOG}, m AS (SELECT event_id, bits % 4000 AS v FROM ratelog), c AS (SELECT *, CASE WHEN v < 16 THEN 0 ELSE length(bin(v >> 3)) - 1 END AS class FROM m) SELECT event_id, v, class, CASE WHEN class = 0 THEN v >> 3 ELSE (v >> 3) - (1 << class::INT) END AS whole, (v >> 1) & 3 AS fraction, v & 1 AS high, v AS back FROM c")
def vector_classes(spark: SparkSession, folder: str) -> DataFrame:
    """A vector's size as class, whole part within the class, fraction and eighth; and put together again."""
    own = _log(spark, folder).select("event_id", (F.col("bits") % 4000).alias("v"))
    own = own.withColumn("class", F.when(F.col("v") < 16, F.lit(0)).otherwise(fx.floor_log2(F.greatest(fx.shr(F.col("v"), 3), F.lit(1).cast("long")))).cast("long"))
    base = F.when(F.col("class") == 0, F.lit(0).cast("long")).otherwise(fx.shl(F.lit(1).cast("long"), F.col("class")))
    own = own.withColumn("whole", fx.shr(F.col("v"), 3) - base).withColumn("fraction", fx.band(fx.shr(F.col("v"), 1), 3)).withColumn("high", fx.band(F.col("v"), 1))
    return own.withColumn("back", (base + F.col("whole")) * 8 + F.col("fraction") * 2 + F.col("high"))


@query("d17_compound_type", f"{LOG}, f AS (SELECT event_id, bits % 2 AS comp, bits // 2 % 2 AS skip, bits // 4 % 2 AS grp, bits // 8 % 2 AS idx, bits // 16 % 2 AS wedge FROM ratelog) SELECT event_id, CASE WHEN comp = 0 THEN 'none' WHEN skip = 1 THEN 'average' WHEN grp = 0 THEN CASE WHEN idx = 1 THEN 'average' ELSE 'distance' END WHEN wedge = 1 THEN 'wedge' ELSE 'difference' END AS kind FROM f")
def compound_type(spark: SparkSession, folder: str) -> DataFrame:
    """How two predictions are blended."""
    on = lambda k: fx.idiv(F.col("bits"), 1 << k) % 2 == 1
    kind = F.when(~on(0), "none").when(on(1), "average").when(~on(2), F.when(on(3), "average").otherwise("distance")).when(on(4), "wedge").otherwise("difference")
    return _log(spark, folder).select("event_id", kind.alias("kind"))


@query("d18_unit_params", f"{LOG} SELECT event_id, bits - coalesce(lag(bits) OVER (PARTITION BY user_id ORDER BY n), 0) AS change, sum(bits) OVER (PARTITION BY user_id ORDER BY n) >= 0 AS started FROM ratelog")
def unit_params(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters relative to those of the unit before."""
    order = Window.partitionBy("user_id").orderBy("n")
    return _log(spark, folder).select("event_id", (F.col("bits") - F.coalesce(F.lag("bits").over(order), F.lit(0).cast("long"))).alias("change"), (F.sum("bits").over(order) >= 0).alias("started"))


@query("d21_reset_contexts", f"{LOG}, s AS (SELECT *, n // 8 AS tile FROM ratelog) SELECT event_id, CAST(coalesce(sum(bits % 2) OVER (PARTITION BY user_id, tile ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS context FROM s")
def reset_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """A context that gathers within a tile (eight units) and starts anew in the next one."""
    past = Window.partitionBy("user_id", fx.idiv(F.col("n"), 8)).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return _log(spark, folder).select("event_id", F.coalesce(F.sum(F.col("bits") % 2).over(past), F.lit(0).cast("long")).alias("context"))


@query("j1_unit_dispatch", f"WITH {A.OBUS}, e AS (SELECT *, sum((type = 2)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM obus) SELECT conv_id, turn, CAST(sequence AS BIGINT) AS sequence, last_value(CASE WHEN type = 1 THEN md5(payload) END IGNORE NULLS) OVER (PARTITION BY conv_id, sequence ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS metadata FROM e QUALIFY type = 6")
def unit_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with the sequence they belong to and the latest metadata since that began: a new sequence resets it."""
    own = S.segments(A.obus(spark, folder), "conv_id", "turn", F.col("type") == 2).withColumnRenamed("segment", "sequence")
    past = Window.partitionBy("conv_id", "sequence").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("metadata", F.last(F.when(F.col("type") == 1, F.md5("payload")), ignorenulls=True).over(past))
    return own.where("type = 6").select("conv_id", "turn", "sequence", "metadata")
