"""Adaptive distributions, slots, groups and rate control over streams of events (C, E, J, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from tessera.functions import adapters as A, fx
from tessera.operators import streams as S
from tessera.plans.registry import query

N = len(A.KINDS)
CDF = S.flat_cdf(N)
_NEXT = ", ".join(f"CASE WHEN s.symbol <= {k} THEN c.c{k} + ((32768 - c.c{k}) >> (5 + (c.n > 15)::INT + (c.n > 31)::INT)) ELSE c.c{k} - (c.c{k} >> (5 + (c.n > 15)::INT + (c.n > 31)::INT)) END" for k in range(N - 1))
NUMBERED = f"{A.SYMBOLS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM symbols)"
FOLD = f"WITH RECURSIVE {NUMBERED}, c AS (SELECT user_id, CAST(0 AS BIGINT) AS nth, {', '.join(f'{CDF[k]} AS c{k}' for k in range(N - 1))}, 0 AS n FROM (SELECT DISTINCT user_id FROM symbols) UNION ALL SELECT c.user_id, s.nth, {_NEXT}, least(c.n + 1, 32) FROM c JOIN numbered s ON s.user_id = c.user_id AND s.nth = c.nth + 1)"


def _streams(spark: SparkSession, folder: str) -> DataFrame:
    return S.ordered(A.symbols(spark, folder), "user_id", "event_id", "symbol").select("user_id", F.transform("rows", lambda r: r["symbol"]).alias("symbols"))


@query("c4_cdf_update", f"{FOLD} SELECT user_id, {', '.join(f'arg_max(c{k}, nth) AS c{k}' for k in range(N - 1))}, arg_max(n, nth) AS count FROM c GROUP BY user_id")
def cdf_update(spark: SparkSession, folder: str) -> DataFrame:
    own = _streams(spark, folder).select("user_id", S.adapted_cdf(F.col("symbols"), N).alias("s"))
    return own.select("user_id", *[F.col("s.cdf")[k].alias(f"c{k}") for k in range(N - 1)], F.col("s.count").alias("count"))


_COST = f"CAST(floor(-log2(greatest((hi - lo) >> 3, 1) / 4096.0::DOUBLE) * 256 + 0.5) AS BIGINT)"
COSTS = f"WITH {A.SYMBOLS}, p AS (SELECT user_id, event_id, symbol, ([{', '.join(map(str, CDF))}])[symbol + 1] AS hi, coalesce(([{', '.join(map(str, CDF))}])[nullif(symbol, 0)], 0) AS lo FROM symbols)"


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    return A.symbols(spark, folder).withColumn("cost", S.symbol_cost(F.array(*[F.lit(c) for c in CDF]), F.col("symbol")))


@query("c5_symbol_cost", f"{COSTS} SELECT event_id, symbol, {_COST} AS cost FROM p")
def symbol_cost(spark: SparkSession, folder: str) -> DataFrame:
    return _costs(spark, folder).select("event_id", "symbol", "cost")


@query("c6_counting", f"{COSTS} SELECT user_id, CAST(sum({_COST}) AS BIGINT) AS bits FROM p GROUP BY user_id")
def counting(spark: SparkSession, folder: str) -> DataFrame:
    """Bits of a stream under distributions that do not adapt, without writing any."""
    return _costs(spark, folder).groupBy("user_id").agg(F.sum("cost").alias("bits"))


@query("c8_q_context", f"WITH {A.RATELOG} SELECT event_id, bits % 256 AS q, CASE WHEN bits % 256 <= 20 THEN 0 WHEN bits % 256 <= 60 THEN 1 WHEN bits % 256 <= 120 THEN 2 ELSE 3 END AS context FROM ratelog")
def q_context(spark: SparkSession, folder: str) -> DataFrame:
    own = A.ratelog(spark, folder).select("event_id", (F.col("bits") % 256).alias("q"))
    return own.withColumn("context", F.when(F.col("q") <= 20, 0).when(F.col("q") <= 60, 1).when(F.col("q") <= 120, 2).otherwise(3))


@query("c9_clear_counts", f"{FOLD} SELECT user_id, arg_max(c0, nth) + arg_max(c3, nth) AS kept, 0 AS count FROM c GROUP BY user_id")
def clear_counts(spark: SparkSession, folder: str) -> DataFrame:
    state = S.adapted_cdf(F.col("symbols"), N)
    own = _streams(spark, folder).select("user_id", state.alias("s")).select("user_id", S.clear_counts(F.concat(F.slice("s.cdf", F.lit(1), F.lit(N - 1)), F.array(F.col("s.count")))).alias("c"))
    return own.select("user_id", (F.col("c")[0] + F.col("c")[N - 2]).alias("kept"), F.element_at("c", -1).alias("count"))


@query("c10_contexts", f"WITH {A.PIXELS.replace('WITH ', '')}, m AS (SELECT blk, frame, \"by\", bx, CAST(sum(s) AS BIGINT) % 3 AS mode FROM pixels GROUP BY ALL) SELECT m.blk, CAST(coalesce(a.mode, 0) * 3 + coalesce(l.mode, 0) AS BIGINT) AS context FROM m LEFT JOIN m a ON a.frame = m.frame AND a.bx = m.bx AND a.\"by\" = m.\"by\" - 1 LEFT JOIN m l ON l.frame = m.frame AND l.\"by\" = m.\"by\" AND l.bx = m.bx - 1")
def contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Context of a block from the modes above and to the left: a lag along rows and one along columns."""
    mode = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x) % 3
    own = A.blocks(spark, folder).select("blk", "frame", "by", "bx", mode.alias("mode"))
    left = F.lag("mode").over(Window.partitionBy("frame", "by").orderBy("bx"))
    above = F.lag("mode").over(Window.partitionBy("frame", "bx").orderBy("by"))
    zero = F.lit(0).cast("long")
    return own.select("blk", (F.coalesce(above, zero) * 3 + F.coalesce(left, zero)).alias("context"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    own = A.ratelog(spark, folder)
    return own.select("user_id", "event_id", "n", (F.col("bits") % 13).alias("mv"), (F.col("bits") % 4 + 1).alias("weight"))


CANDS = f"WITH {A.RATELOG}, cand AS (SELECT user_id, n, bits % 13 AS mv, bits % 4 + 1 AS weight FROM ratelog), seen AS (SELECT user_id, mv, CAST(sum(weight) AS BIGINT) AS w, min(n) AS first FROM cand GROUP BY ALL), firsts AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS nth FROM seen)"


@query("e5_search_stack", f"{CANDS} SELECT user_id, mv, w, nth FROM firsts WHERE nth <= 8")
def search_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct candidates with summed weights, the first eight seen."""
    seen = _candidates(spark, folder).groupBy("user_id", "mv").agg(F.sum("weight").alias("w"), F.min("n").alias("first"))
    return seen.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("first"))).where("nth <= 8").select("user_id", "mv", "w", "nth")


@query("e6_sort_stack", f"{CANDS} SELECT user_id, mv, w + CASE WHEN first < 2 THEN 640 ELSE 0 END AS weight, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN first < 2 THEN 0 ELSE 1 END, w DESC, first) AS rank FROM firsts WHERE nth <= 8")
def sort_stack(spark: SparkSession, folder: str) -> DataFrame:
    return S.candidate_stack(_candidates(spark, folder), "user_id", "n", "mv", "weight")


@query("j2_layer_drop", f"WITH {A.OBUS} SELECT conv_id, turn, type FROM obus WHERE type NOT IN (1, 2) AND (261 >> CAST(turn % 3 AS INTEGER)) & 1 = 1 AND (261 >> CAST(conv_id % 2 + 8 AS INTEGER)) & 1 = 1 OR type IN (1, 2)")
def layer_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Units of layers that the operating point (idc 0x105) has, and headers, which all layers share."""
    idc = F.lit(0x105)
    has = lambda bit: fx.band(fx.shr(idc, bit), 1) == 1
    header = F.col("type").isin(1, 2)
    return A.obus(spark, folder).where(header | (has(F.col("turn") % 3) & has(F.col("conv_id") % 2 + 8))).select("conv_id", "turn", "type")


def _masked(spark: SparkSession, folder: str) -> DataFrame:
    return A.ratelog(spark, folder).withColumn("mask", F.when(F.col("is_key"), 255).otherwise(F.col("bits") % 256))


_PAST = "OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SLOTS = f"WITH {A.RATELOG}, masked AS (SELECT *, CASE WHEN is_key THEN 255 ELSE bits % 256 END AS mask FROM ratelog), slots AS (SELECT *, {', '.join(f'last_value(CASE WHEN (mask >> {k}) & 1 = 1 THEN n END IGNORE NULLS) {_PAST} AS slot{k}' for k in range(8))} FROM masked)"


@query("j4_reference_update", f"{SLOTS} SELECT event_id, mask, {', '.join(f'slot{k}' for k in range(8))} FROM slots")
def reference_update(spark: SparkSession, folder: str) -> DataFrame:
    return S.slots_before(_masked(spark, folder), "user_id", "n", "mask").select("event_id", "mask", *[f"slot{k}" for k in range(8)])


@query("j5_show_existing", f"{SLOTS} SELECT event_id, n % 8 AS slot, CASE n % 8 {' '.join(f'WHEN {k} THEN slot{k}' for k in range(8))} END AS shown FROM slots")
def show_existing(spark: SparkSession, folder: str) -> DataFrame:
    """What a slot holds when a frame asks for it: an as-of join on the slot's history."""
    own = S.slots_before(_masked(spark, folder), "user_id", "n", "mask")
    return own.select("event_id", (F.col("n") % 8).alias("slot"), F.get(F.array(*[f"slot{k}" for k in range(8)]), (F.col("n") % 8).cast("int")).alias("shown"))


@query("j3_setup_frame", f"{SLOTS}, r AS (SELECT s.event_id, s.n, s.bits % 64 + 16 AS w, p.bits % 64 + 16 AS rw FROM slots s LEFT JOIN ratelog p ON p.user_id = s.user_id AND p.n = s.slot0) SELECT event_id, w, rw, rw IS NOT NULL AND 2 * w >= rw AND w <= 16 * rw AS valid FROM r")
def setup_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the frame in slot 0 can be a reference: at most twice as large and at least a sixteenth."""
    own = S.slots_before(_masked(spark, folder), "user_id", "n", "mask").select("event_id", "user_id", (F.col("bits") % 64 + 16).alias("w"), F.col("slot0").alias("at"))
    past = A.ratelog(spark, folder).select("user_id", F.col("n").alias("at"), (F.col("bits") % 64 + 16).alias("rw"))
    both = own.join(past, ["user_id", "at"], "left")
    return both.select("event_id", "w", "rw", (F.col("rw").isNotNull() & F.coalesce((2 * F.col("w") >= F.col("rw")) & (F.col("w") <= 16 * F.col("rw")), F.lit(False))).alias("valid"))


@query("j6_segment_map_carry", f"WITH {A.RATELOG} SELECT event_id, last_value(CASE WHEN bits % 4 = 0 THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS map_of FROM ratelog")
def segment_map_carry(spark: SparkSession, folder: str) -> DataFrame:
    own = A.ratelog(spark, folder).withColumn("new_map", F.when(F.col("bits") % 4 == 0, F.col("n")))
    return S.carried(own, "user_id", "n", "new_map", "map_of").select("event_id", "map_of")


@query("j7_latest_hdr", f"WITH {A.OBUS} SELECT conv_id, turn, last_value(CASE WHEN type = 2 THEN md5(payload) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hdr FROM obus")
def latest_hdr(spark: SparkSession, folder: str) -> DataFrame:
    own = A.obus(spark, folder).withColumn("new_hdr", F.when(F.col("type") == 2, F.md5("payload")))
    return S.carried(own, "conv_id", "turn", "new_hdr", "hdr").select("conv_id", "turn", "hdr")


@query("j8_frame_end_cdf", f"{FOLD}, last AS (SELECT user_id, max(nth) AS nth FROM c GROUP BY user_id), chosen AS (SELECT user_id % 4 AS frame, arg_max(user_id, (nth, -user_id)) AS user_id FROM last GROUP BY ALL) SELECT frame, ch.user_id AS tile, arg_max(c0, nth) AS c0 FROM chosen ch JOIN c ON c.user_id = ch.user_id GROUP BY frame, ch.user_id")
def frame_end_cdf(spark: SparkSession, folder: str) -> DataFrame:
    """Of the tiles of a frame the distributions of one, the longest, go on."""
    own = _streams(spark, folder).withColumn("frame", F.col("user_id") % 4)
    chosen = own.groupBy("frame").agg(F.max_by("user_id", F.struct(F.size("symbols"), -F.col("user_id"))).alias("user_id"))
    kept = own.join(chosen, ["frame", "user_id"]).select("frame", F.col("user_id").alias("tile"), S.adapted_cdf(F.col("symbols"), N).alias("s"))
    return kept.select("frame", "tile", F.col("s.cdf")[0].alias("c0"))


@query(
    "j9_altref_reorder",
    f"""WITH {A.RATELOG}, seg AS (SELECT *, sum(is_key::INT) OVER (PARTITION BY user_id ORDER BY n) AS segment FROM ratelog),
nth AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY n) - CASE WHEN segment > 0 THEN 1 ELSE 0 END AS nth FROM seg),
part AS (SELECT *, CASE WHEN nth = 0 THEN -1 ELSE (nth - 1) // 4 END AS part FROM nth),
last AS (SELECT *, max(n) OVER m = n AS is_last, count(*) OVER m = 1 AS alone FROM part WINDOW m AS (PARTITION BY user_id, segment, part))
SELECT event_id, n, row_number() OVER (PARTITION BY user_id ORDER BY segment, part, CASE WHEN is_last THEN 0 ELSE 1 END, n) - 1 AS place, is_last AND NOT alone AS hidden FROM last""",
)
def altref_reorder(spark: SparkSession, folder: str) -> DataFrame:
    return S.coded_order(A.ratelog(spark, folder), "user_id", "n", 4).select("event_id", "n", "place", "hidden")


@query("j10_key_segments", f"WITH {A.RATELOG}, s AS (SELECT *, CAST(sum((is_key OR n % 16 = 0)::INT) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS segment FROM ratelog) SELECT user_id, segment, min(n) AS first, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits FROM s GROUP BY ALL")
def key_segments(spark: SparkSession, folder: str) -> DataFrame:
    """From one key frame, forced or every sixteenth, to the next: a session window by count."""
    cut = S.segments(A.ratelog(spark, folder), "user_id", "n", F.col("is_key") | (F.col("n") % 16 == 0))
    return cut.groupBy("user_id", "segment").agg(F.min("n").alias("first"), F.count("*").alias("frames"), F.sum("bits").alias("bits"))


@query("j11_slot_eviction", f"{SLOTS}, l AS (SELECT event_id, n, k, s FROM (SELECT event_id, n, unnest(range(8)) AS k, unnest([{', '.join(f'slot{k}' for k in range(8))}]) AS s FROM slots)) SELECT event_id, arg_min(k, (s, k)) AS slot FROM l WHERE s IS NOT NULL AND s < n - 1 AND k <> 7 GROUP BY event_id")
def slot_eviction(spark: SparkSession, folder: str) -> DataFrame:
    """The slot with the oldest frame, not the last one nor the one kept for the alternate reference."""
    own = S.slots_before(_masked(spark, folder), "user_id", "n", "mask")
    held = F.filter(F.array(*[F.struct(F.col(f"slot{k}").alias("s"), F.lit(k).cast("long").alias("k")) for k in range(7)]), lambda x: x["s"].isNotNull() & (x["s"] < F.col("n") - 1))
    return own.select("event_id", F.array_min(held)["k"].alias("slot")).where("slot is not null")


RATED = f"WITH {A.RATELOG}, rated AS (SELECT *, CAST(bits % 40 AS DOUBLE) / 10.0::DOUBLE AS c, CAST(bits % 200 + 8 AS DOUBLE) AS step FROM ratelog)"
PIXELS, TARGET = 3200.0, 1500.0


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    own = A.ratelog(spark, folder)
    return own.select("*", ((F.col("bits") % 40).cast("double") / 10.0).alias("c"), (F.col("bits") % 200 + 8).cast("double").alias("step"))


_MODEL = "{k} * ({c} + 0.1::DOUBLE) * 3200.0::DOUBLE / pow({q}, 1.3::DOUBLE)"


@query("l2_bits_model", f"{RATED} SELECT event_id, round({_MODEL.format(k='25.0::DOUBLE', c='c', q='step')}, 4) AS predicted FROM rated")
def bits_model(spark: SparkSession, folder: str) -> DataFrame:
    return _rated(spark, folder).select("event_id", F.round(S.bits_model(F.lit(25.0), F.col("c"), F.lit(PIXELS), F.col("step")), 4).alias("predicted"))


OWED = "coalesce(sum(1500.0::DOUBLE - bits) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)"


@query("l6_owed", f"{RATED} SELECT event_id, {OWED} AS owed FROM rated")
def owed(spark: SparkSession, folder: str) -> DataFrame:
    """Bits that the frames before have left of their shares."""
    return _owed(spark, folder).select("event_id", "owed")


def _owed(spark: SparkSession, folder: str) -> DataFrame:
    past = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return _rated(spark, folder).withColumn("owed", F.coalesce(F.sum(F.lit(TARGET) - F.col("bits")).over(past), F.lit(0.0)))


PLANNED = f"{RATED}, o AS (SELECT *, {OWED} AS owed FROM rated), budgets AS (SELECT *, (1500.0::DOUBLE + greatest(-750.0::DOUBLE, least(750.0::DOUBLE, owed / 12.0::DOUBLE))) * 8.0::DOUBLE AS budget FROM o), planned AS (SELECT *, coalesce((SELECT min(q) FROM range(1, 256) t(q) WHERE round(8.0::DOUBLE * {_MODEL.format(k='25.0::DOUBLE', c='c', q='q')}, 3) <= round(budget, 3)), 255) AS q FROM budgets)"


def _planned(spark: SparkSession, folder: str) -> DataFrame:
    """q: the finest step whose cost over a horizon of 8 frames is within the budget, a twelfth of what is owed repaid."""
    own = _owed(spark, folder).withColumn("budget", (TARGET + fx.clip3(F.lit(-0.5 * TARGET), F.lit(0.5 * TARGET), F.col("owed") / 12.0)) * 8.0)
    cost = lambda q: F.round(8.0 * S.bits_model(F.lit(25.0), F.col("c"), F.lit(PIXELS), q), 3)
    return own.withColumn("q", S.finest_step(cost, F.round("budget", 3)))


@query("l3_plan", f"{PLANNED} SELECT event_id, round(budget, 4) AS budget, CAST(q AS INTEGER) AS q FROM planned")
def plan(spark: SparkSession, folder: str) -> DataFrame:
    return _planned(spark, folder).select("event_id", F.round("budget", 4).alias("budget"), "q")


@query("l4_redo", f"{PLANNED}, r AS (SELECT *, bits / greatest({_MODEL.format(k='25.0::DOUBLE', c='c', q='q')}, 1.0::DOUBLE) AS r FROM planned) SELECT event_id, is_key AND NOT (round(r, 6) BETWEEN 0.75 AND 1.33) OR NOT is_key AND round(r, 6) > 4.0 AND bits > greatest(8.0 * 1500.0, owed + 1500.0) AS redo FROM r")
def redo(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a frame is coded again: a key frame far from its prediction, or another one that cost far more."""
    own = _planned(spark, folder)
    r = F.round(F.col("bits") / F.greatest(S.bits_model(F.lit(25.0), F.col("c"), F.lit(PIXELS), F.col("q").cast("double")), F.lit(1.0)), 6)
    far = F.col("is_key") & ~r.between(0.75, 1.33)
    dear = ~F.col("is_key") & (r > 4.0) & (F.col("bits") > F.greatest(F.lit(8.0 * TARGET), F.col("owed") + TARGET))
    return own.select("event_id", (far | dear).alias("redo"))


@query("l5_refit", f"WITH RECURSIVE {RATED.removeprefix('WITH ')}, obs AS (SELECT user_id, n, greatest(CAST(bits AS DOUBLE), 1.0) / ((c + 0.1::DOUBLE) * 3200.0::DOUBLE / pow(step, 1.3::DOUBLE)) AS o FROM rated), k AS (SELECT user_id, n, o AS k FROM obs WHERE n = 0 UNION ALL SELECT k.user_id, o.n, 0.5::DOUBLE * k.k + 0.5::DOUBLE * o.o FROM k JOIN obs o ON o.user_id = k.user_id AND o.n = k.n + 1) SELECT user_id, round(arg_max(k, n), 6) AS k FROM k GROUP BY user_id")
def refit(spark: SparkSession, folder: str) -> DataFrame:
    """The model's constant after all frames of a stream, each one's observation weighing half."""
    seen = F.greatest(F.col("bits").cast("double"), F.lit(1.0)) / ((F.col("c") + 0.1) * PIXELS / F.pow("step", F.lit(1.3)))
    own = S.ordered(_rated(spark, folder).withColumn("o", seen), "user_id", "n", "o")
    return own.select("user_id", F.round(S.smoothed(F.transform("rows", lambda r: r["o"]), 25.0), 6).alias("k"))


@query("l7_golden", f"WITH {A.RATELOG} SELECT event_id, greatest(4, least(24, bits % 256 // 6)) AS boost, n % 16 = 0 AS golden FROM ratelog")
def golden(spark: SparkSession, folder: str) -> DataFrame:
    return A.ratelog(spark, folder).select("event_id", fx.clip3(F.lit(4).cast("long"), F.lit(24).cast("long"), fx.idiv(F.col("bits") % 256, 6)).alias("boost"), (F.col("n") % 16 == 0).alias("golden"))


@query(
    "l8_aq_quantisers",
    f"""WITH {A.PIXELS}, both_ AS (SELECT a.frame, a.x // 16 AS c16, a.y // 16 AS r16, a.x // 64 AS sc, a.s, b.s AS r FROM pixels a JOIN pixels b ON b.frame = a.frame - 1 AND a.y = b.y AND a.x = b.x WHERE a.x % 2 = 0 AND a.y % 2 = 0),
m AS (SELECT *, CAST(sum(s) OVER w AS BIGINT) // count(*) OVER w AS mean FROM both_ WINDOW w AS (PARTITION BY frame, r16, c16)),
p AS (SELECT frame, sc, CAST(sum(abs(s - mean)) AS DOUBLE) AS intra, CAST(sum(abs(s - r)) AS DOUBLE) AS inter FROM m GROUP BY ALL),
i AS (SELECT *, 1.0 + CASE WHEN intra = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - inter / intra)) END AS imp FROM p),
g AS (SELECT *, exp(avg(ln(imp)) OVER (PARTITION BY frame)) AS mean FROM i)
SELECT frame, sc, round(imp, 6) AS importance, CAST(greatest(1, least(255, greatest(100 - 32, least(100 + 32, floor(round(100.0 * pow(imp / mean, -0.35), 6) + 0.5))))) AS BIGINT) AS q FROM g""",
)
def aq_quantisers(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiser of each 64-wide superblock column: finer where the frame before predicts it; steps of one as the step table."""
    own = A.pixels(spark, folder).where("x % 2 = 0 and y % 2 = 0")
    past = own.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col("s").alias("r"))
    both = own.join(past, ["frame", "y", "x"]).select("frame", F.expr("y div 16").alias("r16"), F.expr("x div 16").alias("c16"), F.expr("x div 64").alias("sc"), "s", "r")
    block = Window.partitionBy("frame", "r16", "c16")
    mean = fx.idiv(F.sum("s").over(block), F.count("*").over(block))
    p = both.withColumn("mean", mean).groupBy("frame", "sc").agg(F.sum(F.abs(F.col("s") - F.col("mean"))).cast("double").alias("intra"), F.sum(F.abs(F.col("s") - F.col("r"))).cast("double").alias("inter"))
    share = F.when(F.col("intra") == 0, 1.0).otherwise(fx.clip3(F.lit(0.0), F.lit(1.0), 1.0 - F.col("inter") / F.col("intra")))
    p = p.withColumn("imp", 1.0 + share)
    g = F.exp(F.avg(F.log("imp")).over(Window.partitionBy("frame")))
    q = F.floor(F.round(100.0 * F.pow(F.col("imp") / g, F.lit(-0.35)), 6) + 0.5)
    return p.select("frame", "sc", F.round("imp", 6).alias("importance"), fx.clip3(F.lit(1).cast("long"), F.lit(255).cast("long"), fx.clip3(F.lit(68).cast("long"), F.lit(132).cast("long"), q)).alias("q"))


@query(
    "l1_complexity",
    f"""WITH {A.PIXELS}, half AS (SELECT frame, y // 2 AS y, x // 2 AS x, (CAST(sum(s) AS BIGINT) + 2) >> 2 AS v FROM pixels GROUP BY ALL),
b AS (SELECT h.frame, h.y // 8 AS r, h.x // 8 AS c, h.v, p.v AS pv FROM half h LEFT JOIN half p ON p.frame = h.frame - 1 AND p.y = h.y AND p.x = h.x WHERE h.y // 8 < 2),
m AS (SELECT *, (CAST(sum(v) OVER (PARTITION BY frame, r, c) AS BIGINT) + 32) >> 6 AS mean FROM b),
s AS (SELECT frame, r, c, sum(abs(v - mean)) AS intra, sum(abs(v - pv)) AS inter FROM m GROUP BY ALL)
SELECT frame, round(sum(intra) / (count(*) * 64.0), 6) AS intra, round(sum(CASE WHEN inter IS NULL THEN intra ELSE least(intra, inter) END) / (count(*) * 64.0), 6) AS inter FROM s GROUP BY frame""",
)
def complexity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean deviation of the half-size frame from its 8x8 means, and the lesser of that and the change from the frame before."""
    half = A.pixels(spark, folder).groupBy("frame", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(fx.shr(F.sum("s") + 2, 2).alias("v"))
    past = half.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col("v").alias("pv"))
    own = half.join(past, ["frame", "y", "x"], "left").select("frame", F.expr("y div 8").alias("r"), F.expr("x div 8").alias("c"), "v", "pv").where("r < 2")
    mean = fx.shr(F.sum("v").over(Window.partitionBy("frame", "r", "c")) + 32, 6)
    each = own.withColumn("mean", mean).groupBy("frame", "r", "c").agg(F.sum(F.abs(F.col("v") - F.col("mean"))).alias("intra"), F.sum(F.abs(F.col("v") - F.col("pv"))).alias("inter"))
    n = F.count("*") * 64.0
    return each.groupBy("frame").agg(F.round(F.sum("intra") / n, 6).alias("intra"), F.round(F.sum(F.when(F.col("inter").isNull(), F.col("intra")).otherwise(F.least("intra", "inter"))) / n, 6).alias("inter"))
