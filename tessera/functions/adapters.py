"""Block, stream and log views over the driver's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

FRAME_BLOCKS, FRAME_COLS = 50, 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """blk, frame, by, bx, v: one 8x8 block of 8-bit samples per embedding, frames of 10 x 5 blocks."""
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (F.floor(x.cast("double") * 256 + 0.5) + 128).cast("int"))))
    own = table(spark, folder, "embeddings")
    at = F.pmod("vec_id", F.lit(FRAME_BLOCKS))
    own = own.select("vec_id", F.explode(F.array(v)).alias("v"))  # evaluated here, not where it is used
    return own.select(F.col("vec_id").alias("blk"), F.expr(f"vec_id div {FRAME_BLOCKS}").alias("frame"), F.expr(f"pmod(vec_id, {FRAME_BLOCKS}) div {FRAME_COLS}").alias("by"), F.pmod(at, F.lit(FRAME_COLS)).alias("bx"), "v")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """frame, y, x, s: the samples of the blocks in long form, with blk and the place p in it."""
    long = blocks(spark, folder).select("blk", "frame", "by", "bx", F.posexplode("v").alias("p", "s"))
    return long.select("blk", "frame", "by", "bx", "p", (F.col("by") * 8 + F.expr("p div 8")).alias("y"), (F.col("bx") * 8 + F.col("p") % 8).alias("x"), "s")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """blk, frame, v, ref: each block with the one before it as its prediction."""
    own = blocks(spark, folder)
    before = own.select((F.col("blk") + 1).alias("blk"), F.col("v").alias("ref"))
    return own.join(before, "blk").select("blk", "frame", "v", "ref")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, hex, data: sixteen bytes that follow from the whole text of each document."""
    own = table(spark, folder, "documents")
    return own.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hex")).withColumn("data", F.unhex("hex"))


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, event_id, symbol: the types of events as an alphabet of five, ordered by event_id."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return table(spark, folder, "events").select("user_id", "event_id", (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("symbol"))


def ratelog(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, event_id, n, bits, is_key: events as coded frames of a stream, numbered from 0."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    own = table(spark, folder, "events")
    return own.select("user_id", "event_id", (F.row_number().over(order) - 1).cast("long").alias("n"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("bits"), (F.col("event_type") == "error").alias("is_key"))


def obus(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, type, payload: turns as units of a stream, in the order of turns."""
    kind = F.when(F.col("role") == "system", 2).when(F.col("role") == "user", 1).otherwise(6)
    return table(spark, folder, "conversations").select("conv_id", "turn", kind.cast("int").alias("type"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))


#: The event types of the test data.
KINDS = ("click", "error", "purchase", "signup", "view")

BLOCKS = f"""blocks AS (SELECT vec_id AS blk, vec_id // {FRAME_BLOCKS} AS frame, (vec_id % {FRAME_BLOCKS}) // {FRAME_COLS} AS "by", vec_id % {FRAME_COLS} AS bx,
  list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(CAST(e AS DOUBLE) * 256 + 0.5) + 128)) AS INTEGER)) AS v FROM embeddings)"""
PIXELS = BLOCKS + """,
pixels AS (SELECT blk, frame, "by", bx, p, "by" * 8 + p // 8 AS y, bx * 8 + p % 8 AS x, v[p + 1] AS s FROM blocks, (SELECT CAST(range AS INTEGER) AS p FROM range(64)))"""
PAIRS = PIXELS + """,
pairs AS (SELECT a.blk, a.frame, a.p, a.p // 8 AS i, a.p % 8 AS j, a.s, b.s AS r FROM pixels a JOIN pixels b ON a.blk = b.blk + 1 AND a.p = b.p)"""
DIGESTS = "digests AS (SELECT doc_id, md5(coalesce(text, '')) AS hex FROM documents)"
SYMBOLS = "symbols AS (SELECT user_id, event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS symbol FROM events)"
RATELOG = "ratelog AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS bits, event_type = 'error' AS is_key FROM events)"
OBUS = "obus AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 1 ELSE 6 END AS type, coalesce(text, '') AS payload FROM conversations)"
