"""Mixing sources to target weights.

Sizes are summed per source, targets follow from the weights by filling up (no source above ``most`` times
its size, what it leaves is shared by weight among the others), and a source's repetition rate is its target
over its size. A document is taken floor(rate) times, plus once more if a hash of its id and the source's
seed, as a number from 0 to 1, is below the fraction of the rate. The seed is the one of SEEDS whose draws
come nearest to the source's target, so that also small sources meet theirs: each seed's draws are Bernoulli ones, but
the mix that is taken is the best of 16, and varies less than a single draw would.

Everything is DataFrame expressions. Texts are read once, for their sizes; what follows uses ids, sources
and sizes alone. The targets have one row a source.

Nulls and edge cases: a null or wordless text has size 0; a null source is a source of its own, ordered
last; documents that share a doc_id (or have none) share their draws; sources of size 0 have target 0; an
empty table gives no rows; other columns, whatever their names, are ignored by ``plan`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tessera.functions.lineage import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SEEDS = 16
MOST_BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: Column) -> Column:
    """0 <= draw < 1 for a document and a seed: eight hex digits of an MD5 that serves four seeds."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.floor(seed / 4).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, (F.pmod(seed, F.lit(4)) * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from the rows (source, size). One row a source is what the windows order."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    filled = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")).withColumn("full_at", F.col("cap") / F.col("weight"))
    # sources fill up in the order of full_at: level is the common one if those before are full
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = filled.withColumn("level", rest / left)
    # the first source, in that order, that its level does not overfill
    open_level = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    filled = filled.withColumn("open", open_level)
    level = F.min(F.when(F.col("open").isNotNull(), F.struct(F.col("full_at"), F.col("source").isNull(), F.col("source"), F.col("open")))).over(every)["open"]
    return filled.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target"))


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, whole (copies of every document), fraction (of one more), seed."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = cut(targets(sizes, weights, most).withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate)))
    drawn = sizes.select("source", "size", "doc_id").alias("d").join(planned.select(F.col("source").alias("of"), "fraction"), F.col("source").eqNullSafe(F.col("of")))
    sums = drawn.groupBy("of").agg(*[F.sum(F.when(draw(F.col("doc_id"), F.lit(s)) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)])
    want = F.col("fraction") * F.col("source_size")
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{s}") - want).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]))["seed"]
    return cut(planned.join(sums, F.col("source").eqNullSafe(F.col("of"))).select("source", "source_size", "target", "whole", "fraction", nearest.alias("seed")))


def sizes_of(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    return cut(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(F.col(text_column).cast("string")).alias("size")))


def _copies(doc_id: Column) -> Column:
    return F.col("whole") + F.when(draw(doc_id, F.col("seed")) < F.col("fraction"), 1).otherwise(0)


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sizes = sizes_of(documents, **columns)
    rated = rates(sizes, weights, most).withColumnRenamed("source", "of")
    joined = sizes.join(rated, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(F.col("doc_id")).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents, with all their columns, each as often as the mix takes it.

    The rates are broadcast if there are MOST_BROADCAST_SOURCES sources at most; beyond that the join is left to the planner.
    """
    rated = rates(sizes_of(documents, id_column, text_column, source_column), weights, most)
    name = "mix"
    while any(c.lower().startswith(name) for c in documents.columns):
        name += "_"
    of, rate, copies, copy = f"{name}_of", f"{name}_rate", f"{name}_copies", f"{name}_copy"
    side = rated.select(F.col("source").alias(of), F.struct("whole", "fraction", "seed").alias(rate))
    if rated.count() <= MOST_BROADCAST_SOURCES:
        side = F.broadcast(side)
    once_more = F.when(draw(F.col(f"`{id_column}`").cast("long"), F.col(f"{rate}.seed")) < F.col(f"{rate}.fraction"), 1).otherwise(0)
    joined = documents.join(side, F.col(f"`{source_column}`").cast("string").eqNullSafe(F.col(of))).withColumn(copies, (F.col(f"{rate}.whole") + once_more).cast("int"))
    repeated = joined.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*[F.col(f"`{c}`") for c in documents.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM o), 0.0)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
p AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS fraction FROM r),
u AS (SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.fraction, k.seed, CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(k.seed // 4 AS VARCHAR)), 1 + 8 * (k.seed % 4), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT CAST(range AS INTEGER) AS seed FROM range(16)) k),
e AS (SELECT source, seed, abs(sum(CASE WHEN u < fraction THEN size ELSE 0 END) - any_value(fraction) * any_value(source_size)) AS off FROM u GROUP BY source, seed),
b AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM e GROUP BY source)
SELECT u.doc_id, u.size, u.source_size, u.target, CAST(u.size * (u.whole + CASE WHEN u.u < u.fraction THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.seed = b.seed
"""
