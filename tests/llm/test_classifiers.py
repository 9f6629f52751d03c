import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality_classifier as Q, samples, toxicity as X

from .helpers import SPACED


def held_out(d, folds, fold):
    return (zlib.crc32(str(d).encode()) % folds if d is not None else 0) == fold


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(1)
    terms = [b"abacus", b"bad", b"cabbages", b"dada", b"abab", b"baccalaureate"]
    machine = X.Automaton.of(terms)
    words = ["".join(rng.choice("abcdexlug") for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    words += ["".join(c if rng.random() > 0.15 else rng.choice(["", "a", "x" + c]) for c in rng.choice(terms).decode()) or "a" for _ in range(1500)]
    flat = X.ragged.words_of(pa.array([" ".join(words)]))
    term, cost = machine.run(flat.data, flat.start, flat.length)
    for w, t, e in zip(words, term.tolist(), cost.tolist(), strict=True):
        found = [(edits(w.encode(), x), k) for k, x in enumerate(terms) if edits(w.encode(), x) <= (2 if len(x) >= X.TWO_EDITS else 1)]
        assert (e, t) == min(found) if found else t == -1


def test_stems_take_any_ending():
    machine = X.Automaton.of([b"veju", b"idiot"], frozenset([b"veju"]))
    flat = X.ragged.words_of(pa.array(["veju vejux vejuabc vju idiots idiotic"]))
    assert machine.run(flat.data, flat.start, flat.length)[0].tolist() == [0, 0, 0, -1, 1, -1]


def test_toxicity_learns_and_scores(docs, labels, odd, none):
    found = X.toxicity(docs, labels)
    rows = found.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert found.count() == docs.count()
    toxic, clean = [r for r in rows if r.y], [r for r in rows if not r.y]
    assert sum(r.predicted for r in clean) <= 0.1 * len(clean) + 1
    assert X.toxicity(odd, labels).count() == odd.count() and X.toxicity(none, labels).count() == 0
    assert {r.score for r in X.toxicity(odd, labels.where(F.lit(False))).collect()} == {0.0}
    assert toxic


def sentence(rng, extra=()):
    words = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(rng.randrange(2, 5))) for _ in range(30)]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


def test_misspellings_and_quotations():
    rng = random.Random(3)
    bad = ["blockhead", "dimwit", "numbskull"]
    rows = [(sentence(rng, rng.sample(bad, 2)), 1) for _ in range(200)] + [(sentence(rng), 0) for _ in range(400)]
    model = X.learn(rows)
    assert set(bad) <= {t.decode() for t in model.terms}
    texts = [sentence(rng, ["bl0ckhead"]), sentence(rng, ["dimwitt", "nmbskul"]), sentence(rng), f"{sentence(rng)} he said “dimwit” is a word {sentence(rng)}", "", None, "you are a dimwit, numbskull"]
    x, counts = model.features(pa.array(texts, pa.string()))
    score = model.scores(x)
    assert score[0] >= 0.3 and score[1] >= 0.3 and score[6] >= 0.3
    assert score[2] < 0.3 and score[3] < 0.3 and score[4] < 0.3 and score[5] == score[4]
    assert counts[0].tolist() == [1, 1, 0] and counts[3, 2] == 1


def test_machine_scores_pairs():
    """The sum of squares identity against all pairs."""
    rng = np.random.default_rng(1)
    linear, factors = rng.normal(size=50), rng.normal(size=(50, 4))
    x = Q.Features(rng.integers(0, 50, 30), rng.normal(size=30), np.array([0, 7, 19, 30]))
    got = Q.raw(0.3, linear, factors, x)[0]
    for r in range(3):
        own = range(x.first[r], x.first[r + 1])
        want = 0.3 + sum(linear[x.place[i]] * x.value[i] for i in own) + sum(factors[x.place[i]] @ factors[x.place[j]] * x.value[i] * x.value[j] for i in own for j in own if i < j)
        assert abs(got[r] - want) < 1e-9


def test_quality_learns_and_scores(docs, labels, odd, none):
    rows = Q.quality(docs, labels).join(labels.groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    good = [r for r in rows if r.y]
    assert sum(r.predicted for r in good) >= 0.95 * len(good)
    assert Q.quality(odd, labels).count() == odd.count() and Q.quality(none, labels).count() == 0
    assert {r.score for r in Q.quality(odd, labels.where(F.lit(False))).collect()} == {0.5}
    kept = Q.accepted(odd, labels)
    assert kept.columns == odd.columns
    assert Q.quality(docs.select("doc_id", "text"), labels).count() == docs.count()


def test_samples_are_bounded_and_leave_the_fold_out(docs, labels, spark):
    known = {r.text for r in docs.collect() if r.text and held_out(r.doc_id, 5, 0)} - {r.text for r in docs.collect() if not held_out(r.doc_id, 5, 0)}
    rows = samples.labelled(docs, labels, "quality", 5, 0, 40)
    assert 0 < len(rows) <= 44 and not known & {t for t, _ in rows}
    clash = spark.createDataFrame([(0, 0), (0, 1), (1, None), (None, 1)], "doc_id long, quality int")
    assert samples.labelled(docs, clash, "quality", 5, 0, 40) == []


def test_scores_do_not_depend_on_the_share_that_is_sampled():
    rng = random.Random(7)
    bad = ["blockhead", "dimwit", "numbskull"]
    clean = [(sentence(rng, ["dimwit"] * (k % 15 == 0)), 0) for k in range(4000)]
    toxic = [(sentence(rng, [rng.choice(bad)] if k % 2 else rng.sample(bad, 2)), 1) for k in range(400)]
    texts = pa.array([sentence(rng, ["numbskull"]), sentence(rng)])
    found = [m.scores(m.features(texts)[0]) for m in (X.learn(clean + toxic), X.learn(clean[::4] + toxic, stands_for={0: 4.0, 1: 1.0}), X.learn(clean[::4] + toxic))]
    odds = [np.log(p / (1 - p)) for p in found]
    assert np.abs(odds[0] - odds[1]).max() < 0.7 < np.abs(odds[0] - odds[2]).max()


def test_sampled_rows_stand_for_all(docs, labels):
    all_of = {r.toxic: r["count"] for r in labels.join(docs.select("doc_id"), "doc_id").groupBy("toxic").count().collect()}
    rows, stands_for = samples.weighted(docs, labels, "toxic", 4, 2, 10**6)
    assert stands_for == {0: 1.0, 1: 1.0}
    few, stands_for = samples.weighted(docs, labels, "toxic", 4, 2, 40)
    for k in (0, 1):
        whole, part = sum(y == k for _, y in rows), sum(y == k for _, y in few)
        assert whole <= all_of[k] and (stands_for[k] == 1 and part == whole or abs(part * stands_for[k] - whole) < 0.6 * whole)


def test_rare_terms_and_stems_are_looked_up_with_edits():
    """A long-tailed lexicon: 130 terms, each in 0.8% of the toxic texts, and a stem with many endings."""
    rng = random.Random(13)
    bad = [f"{a}{b}" for a in ("bx", "vg", "qd", "wz", "fj") for b in ("acow", "epiy", "ihat", "otub", "usop", "yvas", "adew", "ebip", "icoh", "odut", "ufys", "yhav", "azew", "evoc", "iwuz", "opyg", "ubax", "yceh", "ahiv", "eyob", "iguw", "ovyd", "uzap", "ypec", "awis", "ufoh")]
    rows = [(sentence(rng, [bad[k % 130], f"schwatz{rng.choice('aeiou')}{rng.choice('bdfgh')}{rng.choice('aeiou')}"]), 1) for k in range(2600)] + [(sentence(rng), 0) for _ in range(2600)]
    model = X.learn(rows)
    terms = {t.decode() for t in model.terms}
    assert len(terms & set(bad)) == 130 and any(t.startswith("schwatz") for t in terms)
    texts = [sentence(rng, [bad[7] + "p", bad[90][:-1]]), sentence(rng, ["schwotzubi"])]
    _, counts = model.features(pa.array(texts))
    assert counts[:, 1].tolist() == [2, 1]


def slow_features(model, text, stated):
    """Places and values of a text's features, word by word and byte by byte."""
    words, raw = [w.encode() for w in SPACED.findall(text or "")], (text or "").encode()
    n, many, size = len(words), max(len(words), 1), max(len(raw), 1)
    grams = [tuple(words[k : k + 4]) for k in range(n - 3)]
    dense = [math.log1p(n), sum(map(len, words)) / many, len(set(words)) / many, max((words.count(w) for w in set(words)), default=0) / many]
    dense += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, (len(grams) - len(set(grams))) / many, sum(len(w) > 24 for w in words) / many]
    dense += [sum(bool(kind[b]) for b in raw) / size for kind in Q._KINDS.values()]
    known = stated is not None
    dense += [math.log1p(max(stated, 0)) if known else None, stated - len(text or "") if known else None]
    buckets = sorted({int(X.ragged.words_of(pa.array([w.decode()])).hashes()[0] % np.uint64(Q.BUCKETS)) for w in words})
    found = [(Q.BUCKETS + k * (Q.BINS + 2) + (0 if v is None else sum(e <= v for e in model.edges[k]) + 1), 1 / math.sqrt(len(dense))) for k, v in enumerate(dense)]
    return found + [(b, 1 / math.sqrt(len(buckets))) for b in buckets]


def test_quality_scores_equal_all_pairs_of_slow_features(docs, labels):
    model = Q.learned(docs, labels)
    rows = sorted(docs.where("length(text) < 1500 or text is null").limit(25).collect(), key=lambda r: r.doc_id)
    got = Q._scores(model, pa.array([r.text for r in rows], pa.string()), pa.array([r.n_chars for r in rows], pa.float64()))
    for r, score in zip(rows, got, strict=True):
        own = slow_features(model, r.text, r.n_chars)
        z = model.bias + sum(model.linear[p] * v for p, v in own)
        z += sum(float(model.factors[p] @ model.factors[q]) * v * w for k, (p, v) in enumerate(own) for q, w in own[:k])
        assert abs(score - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-9


def test_quality_tells_both_classes_apart_on_rows_held_out(spark):
    """Prose against junk of three kinds, 2,000 rows: a scorer that says one thing of all fails. (The test data have 11 bad rows.)"""
    rng = random.Random(31)
    junk = [lambda: " ".join([sentence(rng).split()[0]] * rng.randrange(30, 60)), lambda: " ".join(f"{w} {rng.choice('#*|&%$')}{rng.choice('<>|#')}" for w in sentence(rng).split()), lambda: "!! ".join(sentence(rng).upper().split())]
    texts = [(k, rng.choice(junk)() if k % 5 == 0 else sentence(rng).capitalize() + ". " + sentence(rng) + ".", int(k % 5 > 0)) for k in range(2000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    rows = Q.quality(frame.select("doc_id", "text"), frame.select("doc_id", "quality")).join(frame.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    for y in (0, 1):
        own = [r for r in rows if r.quality == y]
        assert len(own) > 50 and sum(r.predicted == y for r in own) >= 0.9 * len(own)


def slow_term(model, word):
    """Place and edits of the term that a word is: fewest edits, then the first; -1 for none."""
    best = None
    for k, term in enumerate(model.terms):
        term = term.decode()
        bound = 0 if not model.doubts[k] else 2 if len(term) >= X.TWO_EDITS else 1
        if term in model.stems:
            bound = 0 if not model.doubts[k] else 2 if len(term) >= X.TWO_EDITS else 1
            cost = min(edits(word[:n], term) for n in range(len(word) + 1))
        else:
            cost = edits(word, term)
        if cost <= bound and (best is None or cost < best[0]):
            best = (cost, k)
    return (best[1], best[0]) if best else (-1, 0)


def test_toxic_terms_are_those_of_slow_edit_distances(docs, labels):
    model = X.learn(samples.weighted(docs, labels, "toxic", 4, 2, 6000)[0])
    rng = random.Random(5)
    bad = ["blockhead", "dimwit", "gruñón", "numbskull"]
    other = X.learn([(sentence(rng, rng.sample(bad, 2)), 1) for _ in range(150)] + [(sentence(rng), 0) for _ in range(300)])
    assert {"gruñón", "dimwit"} <= {t.decode() for t in other.terms}
    texts = [sentence(rng, ["Blockheads", "GRUÑÓN", "grunón,", "dimwot", "«numbskull»", "nmbskul"]), "É è gruñon", ""]
    texts += [r.text for r in docs.where("length(text) < 900").limit(20).collect()]
    for m in (model, other):
        for text in texts:
            words = X.Letters.of([text])
            start, length = X.trimmed(words)
            term, cost = m.automaton.run(words.data, start, length)
            for k in range(len(start)):
                assert (int(term[k]), int(cost[k]) if term[k] >= 0 else 0) == slow_term(m, words.text(k, start, length))
    counts = other.features(pa.array(texts[:1]))[1]
    assert counts[0, 0] >= 5


def test_toxicity_is_found_in_rows_held_out(spark):
    """A hundred terms, some in compounds, some misspelled or in capitals: recall and precision outside the labelled fold."""
    rng = random.Random(29)
    bad = ["".join(rng.choice("bcdfghjklmnpqrstvwz") + rng.choice("aeiouy") for _ in range(4)) for _ in range(100)]

    def spelled(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w.upper(), w + "s", w[:k] + w[k + 1 :], w[:k] + "x" + w[k + 1 :]])

    rows = [(k, sentence(rng, [spelled(w) for w in rng.sample(bad, 2)]) if k % 8 == 0 else sentence(rng), int(k % 8 == 0)) for k in range(8000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = X.toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).join(frame.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in found)
    assert hits >= 0.8 * sum(r.toxic for r in found) and hits >= 0.9 * sum(r.predicted for r in found)
