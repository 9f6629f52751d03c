from tessera.llm import license_scan as L

from .helpers import ALNUM, low


def brute(rows, threshold=0.8):
    out = []
    for d, t in rows:
        w = ALNUM.findall(low(t))
        places, base = [], set()
        for phrase, label in L.PHRASES.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    base.add(label)
        score, labels = (1.0 if base else 0.0), set(base)
        for line in (low(t) or "").split("\n"):
            have = set(ALNUM.findall(line))
            for label, texts in L.TEMPLATES.items():
                for x in texts:
                    template = set(x.split())
                    share = len(have & template) / len(template)
                    if 10 * len(have & template) >= 8 * len(template):
                        labels.add(label)
                        score = max(score, share)
        out.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in L.scan(frame).collect()), key=repr)


def test_equals_every_line_against_every_template(docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert any(r[5] for r in want) and any(r[6] and not r[5] for r in want)


def test_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(50, "Under the MIT\nLicense. Licensed under the Apache License,\nVersion 2.0!"), (51, "CC BY-NC cc by nc cc-by-nc"), (52, "This work is licensed by the GNU General Public License version 3"), (53, "All\nrights\nreserved"), (54, "all rights reserved\r\n"), (55, "under the mit"), (None, "license")], "doc_id long, text string")
    frame = odd.select("doc_id", "text").unionByName(more)
    assert got(frame) == brute([(r.doc_id, r.text) for r in frame.collect()])
    assert got(none) == []
    assert len(got(odd)) == odd.count()


def test_order_of_words_changes_no_result():
    frequent = {k: 10**6 - k for k in range(len(L.vocabulary(L.TEMPLATES)))}
    a, b = L.Templates.of(L.TEMPLATES, {}, L.THRESHOLD), L.Templates.of(L.TEMPLATES, frequent, L.THRESHOLD)
    for texts in L.TEMPLATES.values():
        for t in texts:
            h = L._hashes(t + " and more words")
            x, y = ({k for k in s.ranks(h) if k < len(s.words)} for s in (a, b))
            assert a.met(sorted(x), len(h)) == b.met(sorted(y), len(h))


def test_notices_that_are_wrapped_over_lines(spark):
    words = L.TEMPLATES["mit"][1].split()
    mit = "MIT License\n\n" + "\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11))
    apache = "# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"
    rows = [(1, mit), (2, apache), (3, "You may obtain a copy of the License at\nthe office."), (4, "All\nrights\nreserved")]
    found = {r.doc_id: (r.labels, r.score) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("mit", 1.0), 2: ("apache-2", 1.0), 3: ("", 0.0), 4: ("", 0.0)}


def test_long_lines_need_a_window_about_as_long_as_the_template(spark):
    """Words of a template that are strewn over a long line are no notice; the notice inside such a line is one."""
    import random

    rng = random.Random(2)
    words = L.TEMPLATES["mit"][1].split()
    strewn = " ".join(w for k in rng.sample(range(len(words)), len(words)) for w in [words[k], *(f"w{rng.randrange(10**6)}" for _ in range(9))])
    inside = " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(300)), *words, *(f"w{rng.randrange(10**6)}" for _ in range(300))])
    rows = [(1, strewn), (2, inside), (3, "He reserved a table, as all of them had, and read about civil rights."), (4, "reserved " * 50_000), (5, "x " * 40 + "All rights reserved." + " y" * 40)]
    found = {r.doc_id: (r.labels, r.score) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("", 0.0), 2: ("mit", 1.0), 3: ("", 0.0), 4: ("", 0.0), 5: ("proprietary", 1.0)}
