import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import containers as C


def test_leb128_and_units_of_all_sizes():
    rng = random.Random(1)
    for size in (0, 1, 127, 128, 16383, 16384):
        payload = rng.randbytes(size)
        code = bytearray()
        n = size
        while True:
            code.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                break
        data = bytes([6 << 3 | 6, 3 << 5 | 2 << 3]) + bytes(code) + payload + bytes([1 << 3]) + b"rest"
        assert list(C.units(data)) == [(6, 3, 2, payload), (1, 0, 0, b"rest")]


def test_mkv_and_mp4_round_trips():
    rng = random.Random(2)
    for n in range(1, 8):
        frames = [rng.randbytes(rng.randrange(1, 400)) for _ in range(n)]
        assert [f for _, f in C.mkv_frames(C.mkv_file(frames))] == frames
        data = C.mp4_file(frames, 3)
        rows = list(C.mp4_tables(data))
        assert [b for k, _, b, _ in rows if k == "size"] == [len(f) for f in frames]


@pytest.mark.parametrize("reader", [C.ivf_frames, C.units, C.annexb_units, C.mkv_frames, C.mp4_tables, C.y4m_frames, C.sized_parts])
def test_any_bytes_end_in_rows_or_a_named_fault(spark, reader):
    rng = random.Random(3)
    whole = C.mp4_file([b"abc", b"defg"]) + C.mkv_file([b"xyz"]) + b"DKIF" + bytes(40)
    rows = [(k, rng.randbytes(rng.randrange(0, 60)) if k % 2 else bytes(b ^ (rng.random() < 0.02) for b in whole[rng.randrange(20) :])) for k in range(80)]
    rows += [(100, b""), (101, None), (102, b"DKIF" + bytes(28) + b"\xff" * 12), (103, b"\x80")]
    width = {C.ivf_frames: "a bigint, b binary", C.units: "a int, b int, c int, d binary", C.annexb_units: "a int, b int, c int, d int, e binary", C.mkv_frames: "a bigint, b binary", C.mp4_tables: "a string, b bigint, c bigint, d bigint", C.y4m_frames: "a int, b int, c int, d binary", C.sized_parts: "a int, b binary"}[reader]
    frame = spark.createDataFrame(rows, "k long, data binary")
    found = C.scan(frame, "k", "data", reader, width)
    assert found.where("error is not null and message is null").count() == 0
    assert found.columns[-2:] == ["error", "message"]


def test_ivf_source_writes_and_reads(spark, tmp_path):
    from tessera.sources.datasource import IvfSource, read_ivf

    spark.dataSource.register(IvfSource)
    frames = spark.range(20).select(F.col("id").alias("pts"), F.encode(F.concat(F.lit("frame "), "id"), "utf-8").alias("data")).repartition(3)
    frames.write.format("ivf").mode("append").option("width", 80).save(str(tmp_path / "out"))
    back = spark.read.format("ivf").load(str(tmp_path / "out"))
    assert sorted((r.pts, bytes(r.data)) for r in back.collect()) == [(k, f"frame {k}".encode()) for k in range(20)]
    assert read_ivf(spark, str(tmp_path / "out")).where("error is null").count() == 20
