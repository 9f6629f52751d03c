"""Queries over planes whose last frame lacks blocks, and streams that lack bytes, against their SQL."""

import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import coder
from tessera.plans import registry

PLANES = (
    "f10_inter_driver", "f11_interpolation", "h10_wiener", "h11_box_filter", "h11_self_guided", "h1_loop_filter", "h4_edge_filter6", "h4_edge_filter8", "h4_edge_filter16",
    "h5_cdef_driver", "h7_cdef_filter", "h8_superres_upscale", "h9_restoration", "i7_frame_md5", "i1_output_pack", "a10_y4m_scan", "k9_motion_full",
)


@pytest.fixture(scope="module", params=[6, 32])
def ragged(request, tmp_path_factory, data):
    """A folder with one whole frame and one of so many blocks."""
    rows = pq.read_table(f"{data}/embeddings.parquet").sort_by("vec_id").slice(0, 50 + request.param)
    folder = tmp_path_factory.mktemp(f"ragged{request.param}")
    pq.write_table(rows, folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", PLANES)
def test_frames_that_lack_blocks(spark, ragged, name):
    frame = registry.queries()[name](spark, ragged)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{ragged}/embeddings.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = sorted(c[0] for c in cursor.description)
    at = [[c[0] for c in cursor.description].index(n) for n in names]
    assert sorted(tuple(r[n] for n in names) for r in frame.collect()) == sorted(tuple(r[k] for k in at) for r in cursor.fetchall())


def test_whole_files_of_frames_that_lack_blocks(spark, ragged):
    assert [r.same for r in registry.queries()["a11_y4m_sink"](spark, ragged).collect()] == [True, True]


def test_streams_that_end_like_others(spark):
    """Without its last byte this stream is one of as many other symbols, closing bit included."""
    rng = random.Random(5)
    symbols = next(s for s in ([rng.randrange(5) for _ in range(60)] for _ in range(20_000)) if _closed_when_cut(s))
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate(symbols)], "user_id long, event_id long, symbol int")
    whole = coder.encode_streams(rows, "user_id", "event_id", "symbol", 5)
    cut = whole.withColumn("data", F.expr("substring(data, 1, octet_length(data) - 1)"))
    assert {r.closed for r in coder.decode_streams(whole, "user_id", 5).collect()} == {True}
    assert {r.closed for r in coder.decode_streams(cut, "user_id", 5).collect()} == {False}


def _closed_when_cut(symbols):
    decoder, distribution = coder.Decoder(coder.encoded(symbols, 5)[:-1]), coder.Distribution.flat(5)
    for _ in symbols:
        decoder.symbol(distribution)
    return decoder.closed()
