from pyspark.sql import functions as F

from tessera.functions import adapters as A
from tessera.operators import streams as S
from tessera.streaming import slots as T


def _streamed(spark, tmp_path, frame, make, name):
    """Rows of a streaming query over the frame's rows, a third of the order at a time."""
    path = str(tmp_path / "in")
    most = frame.agg(F.max("n")).first()[0]
    for k in range(3):
        part = frame.where((F.col("n") >= most * k // 3 + (k > 0)) & (F.col("n") <= most * (k + 1) // 3))
        part.coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = make(source).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_slots_in_a_stream_are_those_of_the_batch(spark, data, tmp_path):
    own = A.ratelog(spark, data).where("user_id < 3")
    masked = own.select(F.col("user_id").alias("stream"), "n", F.when(F.col("is_key"), 255).otherwise(F.col("bits") % 256).cast("long").alias("mask"))
    found = _streamed(spark, tmp_path, masked, T.slots, "slots_out")
    names = ["stream", "n", *[f"slot{k}" for k in range(8)]]
    want = S.slots_before(masked, "stream", "n", "mask").select(*names)
    assert found.where("error is not null").count() == 0
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
