import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def brute(rows):
    groups = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append(i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        same = groups.get(data, [])
        best = max((k for k in same if k is not None), default=None)
        again = len(same) > 1 and best is not None and i != best
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=repr)


def got(frame, **options):
    return sorted((tuple(r) for r in warc.round_trip(frame, **options).collect()), key=repr)


def test_sql(spark, data, same_rows):
    same_rows(warc.round_trip(spark.read.parquet(f"{data}/pages.parquet")), warc.ORACLE_SQL)


def test_segments_revisits_and_odd_pages(spark):
    rng = random.Random(1)
    long = ["".join(rng.choice("abc é\r\n\x00WARC/1.1") for _ in range(n)) for n in (999, 1000, 1001, 5000, 20_000)]
    rows = [(k, t) for k, t in enumerate(long * 3 + ["", None, "short", "short"])]
    rows += [(None, long[3]), (None, "x" * 2000), (3, long[3]), (50, "y" * 3000), (50, "y" * 3000), (50, "z" * 3000)]
    frame = spark.createDataFrame([(i, f"http://x/\r\n {i}" if i else None, t, "u", b"p") for i, t in rows], "page_id long, url string, html string, digest string, payload binary")
    assert got(frame) == brute(rows)
    assert got(frame, segment=700, per_file=3) == brute(rows)
    assert got(frame.where(F.lit(False))) == []


def test_framing():
    rng = random.Random(2)
    for n in (0, 1, 10, 8192, 8193, 30_000):
        payload = rng.randbytes(n)
        assert warc.dechunked(warc.chunked(payload, rng.randrange(1, 9000))) == payload
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    parts = [(2, b"b", 2), (1, b"a", None)]
    assert warc.reassembled(parts) == b"ab"
    for broken in ([(1, b"a", None), (3, b"b", 2)], [(1, b"a", None), (2, b"b", 5)], [(2, b"b", 1)]):
        with pytest.raises(ValueError):
            warc.reassembled(broken)


def test_archives_are_plain_records(spark, tmp_path):
    import gzip

    frame = spark.createDataFrame([(1, "http://a/", "hello"), (2, "http://b/", "w" * 1500)], "page_id long, url string, html string")
    warc.write(frame, f"file://{tmp_path}/out", segment=1000)
    content = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out").glob("part-*")))
    kinds = [h["warc-type"] for h, _ in warc.records(content)]
    assert sorted(kinds) == ["continuation", "response", "response"]
    with pytest.raises((ValueError, IndexError)):
        list(warc.records(content[:-3]))
