import hashlib
import random

import numpy as np
import pyarrow as pa

from tessera.llm import decontamination, ragged

from .helpers import ALNUM, low


def brute(rows, items):
    grams = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + m]), set()).add(i)
    sizes = sorted({len(g) for g in grams})
    out = []
    for d, t in rows:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (own := grams.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    found |= own
        named = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_equals_all_windows(spark, data, docs):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(decontamination.contamination(docs, bench)) == want
    assert any(r[-1] for r in want)
    assert got(decontamination.contamination(docs, bench, most=20_000)) == want  # several blocks
    clean = decontamination.decontaminated(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in want if not r[-1]) and clean.columns == docs.columns
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs, bench, most=20_000).collect()) == sorted(r[0] for r in want if not r[-1])


def test_short_items_odd_rows_and_no_items(spark, odd, none):
    items = [(1, "three FOUR five"), (2, "one"), (3, None), (4, ""), (None, "eight nine ten"), (5, "one two three four five six seven eight nine ten"), (5, "seven"), (6, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 nope")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(decontamination.contamination(odd, bench)) == brute(rows, items)
    assert got(decontamination.contamination(odd, bench, most=300)) == brute(rows, items)
    assert got(decontamination.contamination(odd, bench.limit(0))) == brute(rows, [])
    assert got(decontamination.contamination(none, bench)) == []


def test_random_overlaps():
    rng = random.Random(1)
    for _ in range(60):
        word = lambda: "".join(rng.choice("ab") for _ in range(2))
        items = [" ".join(word() for _ in range(rng.randrange(0, 25))) for _ in range(4)]
        texts = [" ".join(word() for _ in range(rng.randrange(0, 120))) for _ in range(5)]
        known = decontamination.Items.of(list(range(4)), items)
        words = ragged.words_of(pa.array(texts), alnum=True)
        hit, found = decontamination.mark(words.hashes(), words.first, known)
        want = brute(list(enumerate(texts)), list(enumerate(items)))
        hits = [int(hit[a:b].sum()) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        assert [(d, w[2], w[3]) for d, w in enumerate(want)] == [(d, hits[d], len(found[d])) for d in range(5)]


def test_repeated_words_are_quick():
    import time

    known = decontamination.Items.of([1, 2], ["ha " * 200, "ha ha ho " * 60])
    words = ragged.words_of(pa.array(["ha " * 100_000, "ha ha ho " * 30_000, "ho " * 9]), alnum=True)
    began = time.perf_counter()
    hit, found = decontamination.mark(words.hashes(), words.first, known)
    assert time.perf_counter() - began < 5
    assert found == [{0}, {1}, set()] and hit.sum() == 190_000


def test_any_ten_shared_words_share_a_fingerprint():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, 40).astype(np.uint64), rng.integers(0, 6, 40).astype(np.uint64)
        i, j = rng.integers(0, 30, 2)
        b[j : j + 10] = a[i : i + 10]
        f = [{int(g[k]) for k in decontamination.fingerprints(g, 6) if s <= k <= s + 5} for g, s in ((ragged.gram_hashes(a, 5), i), (ragged.gram_hashes(b, 5), j))]
        assert f[0] & f[1]
