from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import mixing as M

from .helpers import SPACED


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above the bound is shared again among those that are not."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def check(frame):
    rows = M.plan(frame).collect()
    sizes = defaultdict(int)
    for r in frame.collect():
        sizes[r.source] += len(SPACED.findall(r.text or ""))
    want = brute_targets(sizes)
    assert len(rows) == frame.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.taken == r.size * r.copies and r.copies <= 3
    return rows


def test_targets_and_draws(docs):
    rows = check(docs)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
    off = [abs(taken[r.source] - r.target) / r.target for r in {r.source: r for r in rows}.values()]
    assert sum(off) / len(off) < 0.1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.plan(docs.repartition(5)).collect()))


def test_sql(docs, same_rows):
    same_rows(M.plan(docs).select("doc_id", "size", "source_size", "target", "taken"), M.ORACLE_SQL)


def test_caps_nulls_and_no_words(spark, odd, none):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(1, "a")] * 3 + [(400, "b"), (300, None), (0, "c"), (50, "d")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = check(frame)
    assert all(r.target == 9 for r in found if r.source == "a") and all(r.target == 0 for r in found if r.source == "c")
    check(odd)
    assert M.plan(none).count() == 0 and M.mixed(none).count() == 0
    blank = odd.select("doc_id", F.lit(" ").alias("text"), "source")
    assert all(r.taken == 0 for r in M.plan(blank).collect())


def test_documents_are_repeated(docs, odd):
    for frame in (docs, odd):
        mixed = M.mixed(frame)
        assert mixed.columns == frame.columns
        want = M.plan(frame).agg(F.sum("copies")).first()[0]
        assert mixed.count() == want


def test_names_of_the_mix_may_be_taken(docs):
    names = ["mix_of", "mix_rate", "MIX_copies", "mix__copy"]
    frame = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    left = M.mixed(frame)
    assert left.columns == frame.columns and left.count() == M.mixed(docs).count()
