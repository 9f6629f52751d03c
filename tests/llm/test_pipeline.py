import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.functions import lineage
from tessera.llm import decontamination, mixing, ngram_join, quality_classifier
from tessera.llm.queries import ENCODED, vocabulary


def test_stages_work_on_what_the_last_one_kept(spark, data, docs):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token files"]
    kept, seen = docs, []
    for _, stage in P.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, data).collect(), docs.schema)
        assert kept.columns == docs.columns
        seen.append(kept)
    good, unlike, untested, mixed = seen
    labels, bench = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    scored = {r.doc_id for r in quality_classifier.quality(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == scored and len(scored) < docs.count()
    roots = {r.doc_id for r in ngram_join.similar(good).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in unlike.collect()} == roots
    clean = {r.doc_id for r in decontamination.contamination(unlike, bench).where("not contaminated").collect()}
    assert {r.doc_id for r in untested.collect()} == clean
    copies = {r.doc_id: r.copies for r in mixing.plan(untested).where("copies > 0").collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies

    from tokenizers import Tokenizer

    tool, rows, start = Tokenizer.from_file(vocabulary(ENCODED)), [], 0
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        ids = tool.encode(r.text, add_special_tokens=False).ids + [1]
        rows.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, P.tokens(spark, mixed, data).collect())) == rows
    assert sorted(map(tuple, P.run(spark, data).collect())) == rows


def test_odd_documents_pass_through(spark, data, odd):
    kept = odd
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, data)
        assert kept.columns == odd.columns
    assert P.tokens(spark, kept, data).count() == kept.count()
    empty = odd.where(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_workers_get_batches_of_bounded_bytes(spark, data, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    P.good(spark, docs, data)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches)
    wide = spark.range(0, 6_000, 1, 1).select(F.repeat(F.lit("x"), 4_000).alias("text"))
    found = [r["n"] for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 24_000_000 and max(found) < 2 * lineage.BATCH_BYTES
    for bound, then in (("64m", str(lineage.BATCH_BYTES)), ("1m", "1m")):  # a session that has less keeps it
        spark.conf.set(key, bound)
        lineage.small_batches(spark)
        assert spark.conf.get(key) == then
    spark.conf.unset(key)
