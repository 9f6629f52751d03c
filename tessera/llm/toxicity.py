"""Toxicity: a learned lexicon, looked up through Levenshtein automata, with context-window scores.

The lexicon is learned from labelled texts: words that stand in many different contexts of toxic texts and
in next to none of the others, so that chance among all words does not explain it, and stems (beginnings
shared by several such words, which stand for any continuation). They form a trie, which is intersected with the Levenshtein automata of
its words (one edit, two from ``TWO_EDITS`` letters on); the product is made deterministic once, and all
words of a batch walk through it together, one letter a step, so that nearly all leave it after a few
letters. Letters are code points of the composed lower-case text, in the lexicon and in the texts. Misspellings that the labelled texts use harmlessly are taken off the hits; a term or stem of which
most are harmless is looked for as it is.

Each hit is scored in the window of words around it: quotation marks around it and words of report count
towards quotation, words of address towards abuse. A logistic model weighs the hits of each kind.

Result: doc_id, held_out, score, predicted, and n_terms, n_misspelled, n_quoted.

Nulls and edge cases: null and empty texts have no hits and get the model's score for none; a null doc_id
counts as fold 0; labels that are null, contradictory or without a document are not learned from; without
usable labels of both kinds every score is 0; equal texts get equal scores; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import logistic, ragged, samples

FOLDS, HELD_OUT, CUT = 4, 2, 0.3
SAMPLE_ROWS = 6_000
CHANCE = 0.01  # that any word of the sample becomes a term without being one
STEM_LETTERS, STEM_WORDS = range(4, 9), 6
TWO_EDITS = 8
WINDOW = 6
#: Quotation marks, and words of report and of address in the languages of the corpus.
QUOTES = "\"'“”„«»‘’‹›"
REPORT = "said says say quote quoted quotes called calls word term wrote writes written replied reported reports insult slur means dit mot cite cité appelé gesagt sagte wort zitat nannte genannt dijo dice palabra cita llamó"
ADDRESS = "you your you're youre u ur yourself tu te toi vous votre du dich dein ihr sie eres usted tú"
_EDGE = np.zeros(0x2041, bool)  # marks of ASCII, angle quotes and general punctuation; the last place is for all beyond
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»"]] = True
_EDGE[0x2000:0x2040] = True


@dataclass
class Letters:
    """Words of a run of texts as code points: those of text d are first[d] to first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Letters:
        """Lower-cased and composed; what white space of ASCII separates is a word."""
        texts = [(t or "").lower() for t in texts]
        texts = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
        data = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return cls(np.append(data, np.zeros(1, "<u4")), start, end - start, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)])))

    def text(self, k: int, start: np.ndarray | None = None, length: np.ndarray | None = None) -> str:
        a, n = (self.start if start is None else start)[k], (self.length if length is None else length)[k]
        return self.data[a : a + n].tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Automaton:
    """Deterministic product of a trie with the Levenshtein automata of its words, over code points (or bytes)."""

    classes: np.ndarray  # letter -> its class, 0 for letters of no term
    step: np.ndarray  # state x class -> state, 0 is dead
    term: np.ndarray  # state -> term it accepts (fewest edits, then first), -1 for none
    edits: np.ndarray

    @classmethod
    def of(cls, terms: list, stems: frozenset = frozenset(), exact: frozenset = frozenset(), near: frozenset = frozenset()) -> Automaton:
        """Words that equal or nearly equal a term (equal one of the exact ones), or begin with one of the stems among them (nearly with one of ``near``)."""
        spelled = [t if isinstance(t, bytes) else [ord(c) for c in t] for t in terms]
        letters = sorted({b for t in spelled for b in t})
        classes = np.zeros(0x110000, np.int16)
        classes[letters] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        most, ends, absorbing = [0], {}, set()
        for k, t in enumerate(terms):
            node, bound = 0, 0 if t in exact or t in stems and t not in near else 2 if len(t) >= TWO_EDITS else 1
            most[0] = max(most[0], bound)
            for b in spelled[k]:
                c = int(classes[b])
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    most.append(0)
                node = children[node][c]
                most[node] = max(most[node], bound)
            ends[node] = (k, bound)
            if t in stems:
                absorbing.add(node)

        def closed(states: dict[int, int]) -> frozenset[tuple[int, int]]:
            """Letters of the trie that the word leaves out; of each node the fewest edits."""
            todo = list(states.items())
            while todo:
                node, e = todo.pop()
                if states.get(node, 9) < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= most[child] and states.get(child, 9) > e + 1:
                        states[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(states.items())

        start = closed({0: 0})
        number, rows, queue = {frozenset(): 0, start: 1}, [[0] * (len(letters) + 1)], [start]
        accept = [(-1, 0)]
        for state in queue:
            best = min(((e, ends[n][0]) for n, e in state if n in ends and e <= ends[n][1]), default=(0, -1))
            accept.append((best[1], best[0]))
            row = []
            for c in range(len(letters) + 1):
                then: dict[int, int] = {}
                for node, e in state:
                    if node in absorbing:
                        then[node] = min(then.get(node, 9), e)
                    if e + 1 <= most[node]:  # a letter too many
                        then[node] = min(then.get(node, 9), e + 1)
                    for letter, child in children[node].items():
                        cost = e + (letter != c)
                        if cost <= most[child]:
                            then[child] = min(then.get(child, 9), cost)
                to = closed(then)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                row.append(number[to])
            rows.append(row)
        return cls(classes, np.array(rows, np.int32), np.array([a for a, _ in accept], np.int64), np.array([e for _, e in accept], np.int64))

    def run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term (-1 for none) and edits of each word."""
        end = np.zeros(len(start), np.int64)
        live, state, at = np.arange(len(start)), np.ones(len(start), np.int64), 0
        while len(live):
            over = length[live] == at
            end[live[over]] = state[over]
            live, state = live[~over], state[~over]
            state = self.step[state, self.classes[data[start[live] + at]]]
            goes_on = state > 0
            live, state, at = live[goes_on], state[goes_on], at + 1
        return self.term[end], self.edits[end]


def trimmed(words: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each word without punctuation and quotation marks at its ends; what is inside stays, as letters may be replaced by it."""
    start, length, last = words.start.copy(), words.length.copy(), len(_EDGE) - 1
    live = np.arange(len(start))
    while len(live := live[length[live] > 0]):
        live = live[_EDGE[np.minimum(words.data[start[live]], last)]]
        start[live] += 1
        length[live] -= 1
    live = np.arange(len(start))
    while len(live := live[length[live] > 0]):
        live = live[_EDGE[np.minimum(words.data[start[live] + length[live] - 1], last)]]
        length[live] -= 1
    return start, length


@dataclass
class Model:
    terms: list[bytes]  # in UTF-8
    weights: np.ndarray  # of each term, 0 to 1
    doubts: np.ndarray  # weights of its misspellings
    automaton: Automaton
    harmless: frozenset[str]  # misspellings that are words of their own
    beta: np.ndarray
    stems: frozenset[str] = frozenset()

    FEATURES = 8

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per document: features of the model, and numbers of terms, misspelled ones and quoted ones."""
        words = Letters.of(column.to_pylist())
        docs = len(column)
        start, length = trimmed(words)
        term, edits = self.automaton.run(words.data, start, length)
        out, counts = np.zeros((docs, self.FEATURES)), np.zeros((docs, 3), np.int64)
        for k in np.flatnonzero(term >= 0).tolist():
            if edits[k] and (words.text(k, start, length) in self.harmless or not self.doubts[term[k]]):
                continue
            d = int(np.searchsorted(words.first, k, side="right")) - 1
            quoted, address = self._context(words, k, int(words.first[d]), int(words.first[d + 1]))
            w = float((self.doubts if edits[k] else self.weights)[term[k]])
            out[d, 0 if not edits[k] else 1] += w
            if quoted:
                out[d, 2] += w
            if address:
                out[d, 3] += w
            counts[d] += (1, int(edits[k] > 0), quoted)
        n = np.maximum(np.diff(words.first), 1)
        abuse = np.maximum(out[:, 0] + out[:, 1] - out[:, 2], 0)
        out[:, 4] = abuse > 0
        out[:, 5] = np.log1p(abuse)
        out[:, 6] = np.minimum(100 * abuse / n, 10)
        out[:, 7] = np.log1p(out[:, 2])
        out[:, :4] = np.log1p(out[:, :4])
        return out, counts

    @staticmethod
    def _context(words: Letters, k: int, lo: int, hi: int) -> tuple[bool, bool]:
        """Whether the window around word k makes it a quotation, and whether it addresses someone."""
        near = [words.text(j) for j in range(max(lo, k - WINDOW), min(hi, k + WINDOW + 1))]
        at = k - max(lo, k - WINDOW)
        opened = next((j for j in range(at, -1, -1) if near[j][0] in QUOTES), None)
        closed = next((j for j in range(at, len(near)) if near[j].rstrip(".,;:!?")[-1:] and near[j].rstrip(".,;:!?")[-1] in QUOTES), None)
        between = opened is not None and closed is not None and not any(near[j].rstrip(".,;:!?")[-1:] in tuple(QUOTES) for j in range(opened, at))
        bare = [w.strip(QUOTES + ".,;:!?()[]") for w in near]
        reported, addressed = any(w in _REPORT for w in bare), any(w in _ADDRESS for w in bare)
        return bool(between and (reported or not addressed)), addressed

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.beta):
            return np.zeros(len(features))
        return logistic.sigmoid(features @ self.beta[:-1] + self.beta[-1])


_REPORT, _ADDRESS = frozenset(REPORT.split()), frozenset(ADDRESS.split())


def _words(text: str) -> list[str]:
    words = Letters.of([text])
    start, length = trimmed(words)
    return [words.text(k, start, length) for k in np.flatnonzero(length).tolist()]


def _chance(mine: int, other: int, toxic: float) -> float:
    """Log of how likely at most ``other`` of the texts that hold a word are clean, if a text is toxic with that probability whatever it holds."""
    n = mine + other
    parts = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log1p(-toxic) + (n - k) * math.log(toxic) for k in range(other + 1)]
    return max(parts) + math.log(sum(math.exp(p - max(parts)) for p in parts))


def learn(rows: list[tuple[str, int]], least_contexts: int = 4, least_odds: float = 2.0, stands_for: dict[int, float] | None = None) -> Model:
    """Lexicon and weights from labelled texts. Contexts are pairs of neighbouring words, so that copies of a text count once.

    stands_for: by label, how many labelled texts each row stands for, where the rows are a sample of uneven shares.
    """
    toxic = sum(y for _, y in rows)
    empty = Model([], np.zeros(0), np.zeros(0), Automaton.of([]), frozenset(), np.zeros(0))
    if not rows or not 0 < toxic < len(rows):
        return empty
    known: dict[str, str] = {}  # one object a word: the sample's words are mostly repeated ones
    split = [([known.setdefault(w, w) for w in _words(t)], y) for t, y in rows]
    seen_in: tuple[Counter, Counter] = (Counter(), Counter())  # documents of each label that hold a word
    for words, y in split:
        seen_in[y].update(set(words))
    share = len(rows) / toxic - 1
    each = stands_for or {0: 1.0, 1: 1.0}
    uneven = each[0] / each[1]  # so many times more clean texts than there are in the sample, to each toxic one
    odds = {w: math.log((n + 0.5) / (seen_in[0][w] + 0.5)) + math.log(share) for w, n in seen_in[1].items() if n >= least_contexts}
    hopeful = {w for w, o in odds.items() if o >= least_odds and 25 * uneven * seen_in[0][w] <= seen_in[1][w]}
    contexts: dict[str, set] = defaultdict(set)  # in toxic texts
    for words, y in split:
        if y and not hopeful.isdisjoint(words):
            for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False):
                if w in hopeful:
                    contexts[w].add((a, b))
    # a term shows in more toxic texts and contexts than chance gives any word; words of copies of one text share theirs
    beyond = math.log(CHANCE / len(seen_in[1]))
    terms = {w: seen_in[1][w] for w in hopeful if len(contexts[w]) >= least_contexts and _chance(min(seen_in[1][w], len(contexts[w])), seen_in[0][w], toxic / len(rows)) <= beyond}
    mine_of: Counter = Counter()
    for w, n in seen_in[1].items():
        mine_of.update({w[:m]: n for m in STEM_LETTERS if len(w) >= m})
    begun = {p: [0.0, n, 0] for p, n in mine_of.items() if n >= 2 * STEM_WORDS}  # weight in other texts, number in toxic texts, words there
    del mine_of
    for y, side in enumerate(seen_in):
        for w, n in side.items():
            for m in STEM_LETTERS:
                if len(w) >= m and (found := begun.get(w[:m])):
                    found[0] += 0 if y else n / share
                    found[2] += y
    stems: set[str] = set()
    for stem, (other, mine, words) in sorted(begun.items(), key=lambda x: (len(x[0]), x[0])):
        if words >= STEM_WORDS and 10 * other <= mine and _chance(mine, round(other * share), toxic / len(rows)) <= beyond and not any(stem[:n] in stems for n in STEM_LETTERS):
            longest = max((p for p, b in begun.items() if p[: len(stem)] == stem and 50 * b[1] >= 49 * mine), key=len)
            if 2 * seen_in[1][longest] < mine:  # else it is one word with a few endings
                stems.add(longest)
    terms |= {s: begun[s][1] for s in stems}
    terms = sorted((w for w in terms if w in stems or not any(w[:n] in stems for n in STEM_LETTERS)), key=lambda w: (-terms[w], w))
    if not terms:
        return empty
    others = [begun[w][0] / begun[w][1] if w in stems else seen_in[0][w] / share / seen_in[1][w] for w in terms]
    automaton = Automaton.of(terms, frozenset(stems), near=frozenset(stems))
    # misspellings in the sample: those of harmless texts are words of their own, and cast doubt on others of the term
    seen = sorted(seen_in[0].keys() | seen_in[1].keys())
    flat = Letters.of([" ".join(seen)])
    term, edits = automaton.run(flat.data, flat.start, flat.length)
    tally, harmless = np.zeros((len(terms), 2)), set()
    for k in np.flatnonzero((term >= 0) & (edits > 0)).tolist():
        word = flat.text(k)
        bad = 2 * seen_in[0][word] < share * seen_in[1][word]
        tally[term[k], int(bad)] += 1
        if not bad:
            harmless.add(word)
    doubts = (tally[:, 1] + 1) / (tally.sum(1) + 1)
    doubts[doubts < 0.5] = 0
    exact = frozenset(w for w, sure in zip(terms, doubts, strict=True) if not sure)
    automaton = Automaton.of(terms, frozenset(stems), exact, frozenset(stems))
    model = Model([t.encode("utf-8", "surrogatepass") for t in terms], 1 - np.minimum(others, 1), doubts, automaton, frozenset(harmless), np.zeros(0), frozenset(stems))
    y = np.array([v for _, v in rows], float)
    x = np.concatenate([model.features(pa.array([t for t, _ in rows[k : k + 256]]))[0] for k in range(0, len(rows), 256)])
    weight = np.where(y > 0, each[1], each[0]) / min(each.values())
    model.beta = logistic.fit(x, y, weight)
    return model


def toxicity(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Learn from about ``sample_rows`` labelled texts outside the held-out fold, then score every document."""
    rows, stands_for = samples.weighted(documents, labels, "toxic", FOLDS, HELD_OUT, sample_rows, id_column, text_column)
    model = learn(rows, stands_for=stands_for)
    return scored(documents, model, cut, id_column, text_column)


def scored(documents: DataFrame, model: Model, cut: float = CUT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(model)  # terms of a bounded sample and their automaton

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                x, counts = held.value.features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held.value.scores(x)), *(pa.array(counts[:, k]) for k in range(3))], ["doc_id", "score", "n_terms", "n_misspelled", "n_quoted"])

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    found = texts.mapInArrow(run, "doc_id long, score double, n_terms long, n_misspelled long, n_quoted long")
    held_out = samples.fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_terms", "n_misspelled", "n_quoted")
