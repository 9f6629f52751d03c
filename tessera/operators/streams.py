"""Operators on ordered streams: adaptive distributions, reference slots, carried values, groups and rate control.

What depends on the order within a stream is a window over the stream, or a fold over its ordered rows where
each step needs the state the one before has left. Streams are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tessera.functions import fx


def flat_cdf(n: int) -> list[int]:
    """Cumulative probabilities of n equal symbols, in 2^15ths."""
    return [32768 * (k + 1) // n for k in range(n)]


def cdf_step(state: Column, symbol: Column, n: int) -> Column:
    """struct(cdf, count) after coding ``symbol`` of n."""
    log2 = min(n.bit_length() - 1, 2)
    rate = 3 + (state["count"] > 15).cast("int") + (state["count"] > 31).cast("int") + log2
    up = lambda c: c + fx.shr(32768 - c, rate)
    moved = F.transform(state["cdf"], lambda c, k: F.when(k == n - 1, c).when(k >= symbol, up(c)).otherwise(c - fx.shr(c, rate)))
    return F.struct(moved.alias("cdf"), F.least(state["count"] + 1, F.lit(32)).alias("count"))


def adapted_cdf(symbols: Column, n: int) -> Column:
    """The distribution after an array of symbols, from equal ones."""
    start = F.struct(F.array(*[F.lit(c) for c in flat_cdf(n)]).alias("cdf"), F.lit(0).alias("count"))
    return F.aggregate(symbols, start, lambda s, x: cdf_step(s, x, n))


def symbol_cost(cdf: Column, symbol: Column) -> Column:
    """-log2 of the probability, in steps of 2^-12, as 256ths of a bit."""
    low = F.when(symbol > 0, F.get(cdf, symbol - 1)).otherwise(0)
    p = F.greatest(fx.shr(F.get(cdf, symbol) - low, 3), F.lit(1))
    return F.floor(-F.log2(p / F.lit(4096.0)) * 256 + 0.5).cast("long")


def clear_counts(cdf: Column) -> Column:
    """A distribution with its counter, the last element, reset."""
    return F.concat(F.slice(cdf, F.lit(1), F.size(cdf) - 1), F.array(F.lit(0)))


def ordered(frame: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row a key with its rows as an array in order. For what is sequential by nature: a stream is one task's work."""
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    return frame.groupBy(key).agg(rows.alias("rows"))


def slots_before(frames: DataFrame, key: str, order: str, mask: str, slots: int = 8) -> DataFrame:
    """slot0 ...: for each frame the last one before it (by its number) that refreshed the slot."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.select("*", *[F.last(F.when(fx.band(fx.shr(F.col(mask), k), 1) == 1, F.col(order)), ignorenulls=True).over(past).alias(f"slot{k}") for k in range(slots)])


def carried(frames: DataFrame, key: str, order: str, value: str, to: str) -> DataFrame:
    """The latest value that is not null, up to and with each row."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn(to, F.last(value, ignorenulls=True).over(past))


def segments(frames: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """segment: how many rows that start one there are up to and with each row."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("segment", F.sum(starts.cast("int")).over(past).cast("long"))


def coded_order(frames: DataFrame, key: str, order: str, group: int) -> DataFrame:
    """place, hidden: the order in which frames shown as 1 .. n of each group are coded. The last of a group is
    coded first, ahead of its turn; a key frame is a group of its own and ends the one before."""
    cut = segments(frames, key, order, F.col("is_key"))
    within = Window.partitionBy(key, "segment").orderBy(order)
    cut = cut.withColumn("nth", F.row_number().over(within) - F.when(F.col("segment") > 0, 1).otherwise(0))
    cut = cut.withColumn("part", F.when(F.col("nth") == 0, F.lit(-1).cast("long")).otherwise(fx.idiv(F.col("nth") - 1, group)))
    mine = Window.partitionBy(key, "segment", "part")
    last = F.max(order).over(mine) == F.col(order)
    alone = F.count("*").over(mine) == 1
    coded = Window.partitionBy(key).orderBy("segment", "part", F.when(last, 0).otherwise(1), order)
    return cut.withColumn("place", (F.row_number().over(coded) - 1).cast("long")).withColumn("hidden", last & ~alone)


def bits_model(k: Column, complexity: Column, pixels: Column, step: Column) -> Column:
    """Predicted bits of a frame: k (c + 0.1) pixels / step^1.3."""
    return k * (complexity + 0.1) * pixels / F.pow(step, F.lit(1.3))


def finest_step(cost, budget: Column, top: int = 255) -> Column:
    """The least q from 1 to ``top`` whose cost, a function of q, is within the budget; ``top`` without one.

    Costs fall as q grows, or are within the budget from the first one on: bit by bit the search finds the last q that is not.
    """
    over = lambda q: (q <= top) & ~F.coalesce(cost(q.cast("double")) <= budget, F.lit(False))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(top.bit_length()))])
    last = F.aggregate(steps, F.lit(0), lambda q, step: F.when(over(q + step), q + step).otherwise(q))
    return F.least(last + 1, F.lit(top))


def smoothed(values: Column, start: float, weight: float = 0.5) -> Column:
    """Exponentially weighted mean of an array: the first value replaces the start."""
    state = F.struct(F.lit(start).alias("k"), F.lit(False).alias("fitted"))
    fold = F.aggregate(values, state, lambda s, x: F.struct(F.when(s["fitted"], (1 - weight) * s["k"] + weight * x).otherwise(x).alias("k"), F.lit(True).alias("fitted")))
    return fold["k"]


def candidate_stack(candidates: DataFrame, key: str, order: str, value: str, weight: str, most: int = 8, nearest: int = 2, bonus: int = 640) -> DataFrame:
    """rank, value, weight: distinct candidates with summed weights, the ``most`` first seen; those among the
    ``nearest`` first rows of a key get a bonus and come first, each part by weight, then by first sight."""
    seen = candidates.groupBy(key, value).agg(F.sum(weight).cast("long").alias("w"), F.min(order).alias("first"))
    first = seen.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("first"))).where(F.col("nth") <= most)
    near = F.when(F.col("first") < nearest, bonus).otherwise(0)
    ranked = Window.partitionBy(key).orderBy((F.col("first") >= nearest).cast("int"), F.col("w").desc(), F.col("first"))
    return first.select(key, value, (F.col("w") + near).alias("weight"), F.row_number().over(ranked).cast("long").alias("rank"))
