"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words hashed to ``BUCKETS`` places (each 1 / sqrt(distinct words)), its
structure statistics cut into bins (each bin a feature of value 1), and bins of the metadata (characters of
the text as its row states them, and how far that is from the text's own). With a vector of ``RANK`` numbers
for each feature, all pairwise interactions are scored in time linear in the features by
0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). The machine is fitted by AdaGrad on a bounded sample
of labelled rows; labels, languages, sources and ids are never inputs.

Result: doc_id, held_out, score, predicted.

Nulls and edge cases: null and empty texts are scored by their structure alone; missing or null metadata is
a bin of its own; a null doc_id counts as fold 0; null, contradictory and unmatched labels are not learned
from; without labels of both kinds every score is 0.5; equal rows get equal scores; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import logistic, ragged, samples

FOLDS, HELD_OUT, CUT = 5, 0, 0.3
SAMPLE_ROWS = 6_000
BUCKETS, RANK, BINS = 1 << 14, 8, 16
EPOCHS, RATE, RIDGE, BATCH = 12, 0.1, 1e-3, 64
_ALL = np.arange(256)
_KINDS = {
    "upper": (_ALL >= 65) & (_ALL <= 90),
    "lower": ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128),
    "digit": (_ALL >= 48) & (_ALL <= 57),
    "stop": np.isin(_ALL, [33, 44, 46, 63]),
    "shout": _ALL == 33,
    "mark": np.isin(_ALL, list(b"#*$%&|<>=_~^@\\/{}[]")),
    "bar": _ALL == 124,
    "line": _ALL == 10,
    "control": (_ALL < 32) & (_ALL != 10),
}
STATISTICS = ["words", "word_length", "distinct", "top_word", "repeated_next", "repeated_gram", "long_words", *_KINDS]


def statistics(words: ragged.Words, word: np.ndarray) -> np.ndarray:
    """Structure statistics of each document, one column each of STATISTICS."""
    docs, n = len(words.first) - 1, np.diff(words.first)
    doc = np.repeat(np.arange(docs), n)
    many = np.maximum(n, 1)
    out = np.zeros((docs, len(STATISTICS)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.bincount(doc, words.length, docs) / many
    order = np.lexsort((word, doc))
    d, w = doc[order], word[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    head = np.flatnonzero(fresh)
    often = np.diff(np.append(head, len(w)))
    out[:, 2] = np.bincount(d[head], minlength=docs) / many
    if len(head):
        np.maximum.at(out[:, 3], d[head], often)
        out[:, 3] /= many
    if len(word) > 1:
        same = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        out[:, 4] = np.bincount(doc[1:][same], minlength=docs) / many
    grams = ragged.gram_hashes(word, 4)
    if len(grams):
        inside = np.flatnonzero(doc[: len(grams)] == doc[3:])
        g, gd = grams[inside], doc[inside]
        order = np.lexsort((g, gd))
        again = (gd[order][1:] == gd[order][:-1]) & (g[order][1:] == g[order][:-1])
        out[:, 5] = np.bincount(gd[order][1:][again], minlength=docs) / many
    out[:, 6] = np.bincount(doc[words.length > 24], minlength=docs) / many
    return out


def byte_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each kind of byte in each document."""
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((len(size), len(_KINDS)))
    for k, kind in enumerate(_KINDS.values()):
        running = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        out[:, k] = (running[offsets[1:]] - running[offsets[:-1]]) / size
    return out


@dataclass
class Features:
    """Sparse rows: of row r the places from first[r] to first[r + 1], with values."""

    place: np.ndarray
    value: np.ndarray
    first: np.ndarray


@dataclass
class Machine:
    edges: np.ndarray  # statistic x bin edge
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @property
    def size(self) -> int:
        return len(self.linear)

    def score(self, x: Features) -> np.ndarray:
        return logistic.sigmoid(raw(self.bias, self.linear, self.factors, x)[0]) if self.size else np.full(len(x.first) - 1, 0.5)


def raw(bias: float, linear: np.ndarray, factors: np.ndarray, x: Features) -> tuple[np.ndarray, np.ndarray]:
    """Score before the link, and the sums over v x of each row. Every row has features."""
    vx = factors[x.place] * x.value[:, None]
    sums = np.add.reduceat(vx, x.first[:-1])
    squares = np.add.reduceat((vx**2).sum(1), x.first[:-1])
    return bias + np.add.reduceat(linear[x.place] * x.value, x.first[:-1]) + 0.5 * ((sums**2).sum(1) - squares), sums


def describe(column: pa.Array, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each text, and its distinct word buckets: document and bucket of each.

    stated: characters as the rows state them, NaN where they do not.
    """
    words = ragged.words_of(column)
    word = words.hashes()
    data, offsets = ragged.buffer_of(column)
    dense = np.column_stack((statistics(words, word)[:, : len(STATISTICS) - len(_KINDS)], byte_shares(data, offsets)))
    continuation = np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80, dtype=np.int64)))
    own = np.diff(offsets) - (continuation[offsets[1:]] - continuation[offsets[:-1]])
    dense = np.column_stack((dense, np.log1p(np.maximum(stated, 0)), stated - own))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    pairs = np.unique(doc * BUCKETS + (word % np.uint64(BUCKETS)).astype(np.int64))
    return dense, pairs // BUCKETS, pairs % BUCKETS


def features(edges: np.ndarray, dense: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> Features:
    rows, columns = dense.shape
    bins = np.empty((rows, columns), np.int64)
    for k in range(columns):
        # bin 0 is for what is not known
        bins[:, k] = np.where(np.isnan(dense[:, k]), 0, np.searchsorted(edges[k], dense[:, k], side="right") + 1)
    dense_place = BUCKETS + np.arange(columns) * (BINS + 2) + bins
    n = np.bincount(doc, minlength=rows)
    per_row = n + columns
    first = np.concatenate(([0], np.cumsum(per_row)))
    place, value = np.empty(first[-1], np.int64), np.ones(first[-1])
    is_word = np.ones(first[-1], bool)
    at = (first[:-1, None] + np.arange(columns)).ravel()
    is_word[at] = False
    place[at] = dense_place.ravel()
    value[at] = 1 / np.sqrt(columns)
    place[is_word] = bucket
    value[is_word] = 1 / np.sqrt(np.repeat(n, n))
    return Features(place, value, first)


def _rows(x: Features, rows: np.ndarray) -> Features:
    n = np.diff(x.first)[rows]
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(x.first[rows] - first[:-1], n) + np.arange(first[-1])
    return Features(x.place[at], x.value[at], first)


def fit(rows: list[tuple[str, float, int]], seed: int = 7) -> Machine:
    """Machine from texts, stated characters and labels."""
    y = np.array([r[2] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return Machine(np.zeros((0, 0)), 0.0, np.zeros(0), np.zeros((0, RANK)))
    parts = [describe(pa.array([r[0] for r in rows[k : k + 256]]), np.array([r[1] for r in rows[k : k + 256]], float)) for k in range(0, len(rows), 256)]
    dense = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1] + 256 * k for k, p in enumerate(parts)])
    bucket = np.concatenate([p[2] for p in parts])
    edges = np.array([np.quantile(c[~np.isnan(c)], np.linspace(0, 1, BINS + 2)[1:-1]) if (~np.isnan(c)).any() else np.zeros(BINS) for c in dense.T])
    x = features(edges, dense, doc, bucket)
    size = BUCKETS + len(edges) * (BINS + 2)
    draw = np.random.default_rng(seed)
    linear, factors, bias = np.zeros(size), draw.normal(0, 0.05, (size, RANK)), 0.0
    seen_l, seen_f, seen_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for k in range(0, len(y), BATCH):
            some = order[k : k + BATCH]
            b = _rows(x, some)
            z, sums = raw(bias, linear, factors, b)
            gap = (logistic.sigmoid(z) - y[some]) * weight[some] / len(some)
            per = np.repeat(gap, np.diff(b.first))
            used, back = np.unique(b.place, return_inverse=True)
            g = np.bincount(back, per * b.value) + RIDGE * linear[used]
            inner = (np.repeat(sums, np.diff(b.first), axis=0) - factors[b.place] * b.value[:, None]) * (per * b.value)[:, None]
            gf = np.column_stack([np.bincount(back, inner[:, f]) for f in range(RANK)]) + RIDGE * factors[used]
            seen_l[used] += g**2
            seen_f[used] += gf**2
            seen_b += gap.sum() ** 2
            linear[used] -= RATE * g / np.sqrt(seen_l[used])
            factors[used] -= RATE * gf / np.sqrt(seen_f[used])
            bias -= RATE * gap.sum() / np.sqrt(seen_b)
    return Machine(edges, float(bias), linear, factors)


def _texts(documents: DataFrame, id_column: str, text_column: str, size_column: str) -> DataFrame:
    stated = F.col(size_column).cast("double") if size_column in documents.columns else F.lit(None).cast("double")
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), stated.alias("stated"))


def learned(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> Machine:
    """The machine fitted to about ``sample_rows`` labelled rows (at most 1.1 times as many) outside the held-out fold."""
    return fit(samples.labelled(_texts(documents, id_column, text_column, size_column), labels, "quality", FOLDS, HELD_OUT, sample_rows, extra="stated"))


def quality(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """Score of every document."""
    model = learned(documents, labels, sample_rows, id_column, text_column, size_column)
    held = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x RANK numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(held.value, part.column("text"), part.column("stated")))], ["doc_id", "score"])

    found = _texts(documents, id_column, text_column, size_column).mapInArrow(run, "doc_id long, score double")
    held_out = samples.fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _scores(model: Machine, text: pa.Array, stated: pa.Array) -> np.ndarray:
    if not model.size:
        return np.full(len(text), 0.5)
    return model.score(features(model.edges, *describe(text, stated.to_numpy(zero_copy_only=False).astype(float))))


def accepted(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """The documents, with all their columns, that score ``cut`` or more; no row is shuffled for it."""
    model = learned(documents, labels, sample_rows, id_column, text_column, size_column)
    held = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_column)
    stated_at = documents.columns.index(size_column) if size_column in documents.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays(batch.columns, [f"c{k}" for k in range(batch.num_columns)])
            for part in ragged.slices(whole, f"c{at}"):
                stated = part.column(stated_at).cast(pa.float64()) if stated_at is not None else pa.nulls(part.num_rows, pa.float64())
                good = part.filter(pa.array(_scores(held.value, part.column(at), stated) >= cut))
                yield pa.RecordBatch.from_arrays(good.columns, schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)
