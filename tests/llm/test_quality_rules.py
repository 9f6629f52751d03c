from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q

from .helpers import SPACED


def brute(text):
    text = text or ""
    words, seen, covered = SPACED.findall(text), {}, set()
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            for k in places:
                covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def stats(frame):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.measured(frame).collect()), key=repr)


def test_statistics(docs, odd, none, spark):
    for frame in (docs, odd):
        assert stats(frame) == sorted(((r.doc_id, *brute(r.text)) for r in frame.collect()), key=repr)
    assert stats(none) == []
    texts = ["a b c d e f g h " * 5, "x\n\n x\nx\n  \nx", "a b c d e f g h i a b c d e f g h", "#a *b $% &|<> \x0b\x1c", "w " * 9]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert stats(frame) == sorted(((k, *brute(t)) for k, t in enumerate(texts)), key=repr)


def test_rules_reject_the_class_they_learned(docs, labels):
    rows = Q.judged(docs, labels).join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").collect()
    assert all(not r.kept for r in rows if r.base_failed)
    good, bad = [r for r in rows if r.quality and not r.base_failed], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.95 * len(good)
    assert sum(r.kept for r in bad) <= 0.7 * len(bad)


def test_lists_are_ordered_conditions(spark):
    import random

    rng = random.Random(1)
    rows = [(k, n, n * 5, s, 0, 0, 0, n, int(s * 10 < n)) for k in range(1200) for n, s in [(rng.randrange(30, 200), rng.choice([0, 0, 0, 40]))]]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_distinct long, quality int")
    learned = Q.learn(frame.drop("quality"), frame.select("doc_id", "quality"))
    assert learned.rules and learned.rules[0][0].name == "symbols" and "1. reject if symbols >" in str(learned)
    found = Q.verdicts(frame.drop("quality"), learned).join(frame.select("doc_id", "quality"), "doc_id")
    assert found.where((F.col("quality") == 1) != F.col("kept")).count() <= 12


def test_odd_labels(odd, none, labels, spark):
    empty = labels.where(F.lit(False))
    found = Q.judged(odd, empty)
    assert found.count() == odd.count() and found.where("kept and base_failed").count() == 0
    assert found.where("not base_failed and not kept").count() == 0
    clash = spark.createDataFrame([(5, 0), (5, 1), (None, 0), (7, None)], "doc_id long, quality int")
    assert Q.judged(odd, clash).where("rule is not null").count() == 0
    assert Q.judged(none, labels).count() == 0


def test_verdicts_are_those_of_the_list_read_rule_by_rule(spark, docs, odd):
    """A list from texts with signs, with shouting and with few words, applied by hand to statistics counted by hand."""
    import random

    rng = random.Random(4)
    some = lambda n: [rng.choice("ab cd efg hijk lmnop qrstuv".split()) + str(rng.randrange(300)) for _ in range(n)]
    kinds = [lambda: " ".join(some(60)), lambda: " # ".join(some(40)), lambda: " ".join(some(50)).upper(), lambda: " ".join(some(6) * 2 + some(15) * 2)]
    rows = [(k, kinds[k % 8 if k % 8 < 4 else 0](), int(k % 8 in (0, 4, 5, 6, 7))) for k in range(1600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    learned = Q.learn(Q.measured(frame), frame.select("doc_id", "quality"))
    assert len(learned.rules) > 1
    for frame in (docs, odd):
        got = sorted(((r.doc_id, r.kept, r.rule) for r in Q.verdicts(Q.measured(frame), learned).collect()), key=repr)
        want = []
        for r in frame.collect():
            n, chars, symbols, lines, repeats = brute(r.text)
            words = SPACED.findall(r.text or "")
            each = {"word_length": chars, "symbols": symbols, "repeats": repeats, "upper": sum("A" <= c <= "Z" for c in r.text or ""), "distinct": len(set(words)), "dup_lines": lines}
            value = {"n_words": float(n)} | {k: v / n if n else 0.0 for k, v in each.items()}
            holds = lambda c: value[c.name] > c.threshold if c.above else value[c.name] <= c.threshold
            rule = next((k for k, conditions in enumerate(learned.rules, 1) if all(map(holds, conditions))), None)
            want.append((r.doc_id, not (n < 20 or 100 * repeats > 30 * n) and rule is None, rule))
        assert got == sorted(want, key=repr)
