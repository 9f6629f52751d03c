"""Benchmark decontamination by winnowing.

A text's fingerprints are the least 5-gram hashes of each 6 consecutive 5-grams, all ties kept, so that two
texts with 10 consecutive words in common have at least one fingerprint in common inside them. Training and
test fingerprints are joined, and each hit is extended: the windows of 10 words that hold it are looked up among
the windows of the items and compared word by word, so that every shared span of 10 words or more is marked
whole. A window that many items have is looked up once, however often it stands in a text. Items of fewer than
10 words are one window each: their fingerprint is the hash of all their words, looked up at every place.

Items are dealt out in blocks of about ``most`` bytes of text, and each block is sent to all tasks. Documents are
read once and pass from block to block; a benchmark of any usual size is one block.

Nulls and edge cases: a null or wordless text has no words and no hits; a null or wordless item occurs
nowhere; items that share an item_id count as one, and an item without an item_id marks words but is neither
counted nor named; texts of one word repeated are looked up like any other; equal documents get equal rows; an
empty benchmark marks nothing; other columns, whatever their names, are ignored by ``contamination`` and kept by
``decontaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import ragged

WINDOW, GRAM = 10, 5
MOST_BYTES = 8 << 20
_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"


def fingerprints(grams: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash of some ``window`` consecutive grams."""
    if len(grams) < window:
        return np.arange(0)
    n = len(grams) - window + 1
    least = grams[:n].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : j + n], out=least)
    best = np.zeros(len(grams), np.uint64)  # the largest of the minima of the windows around each place
    for j in range(window):
        np.maximum(best[j : j + n], least, out=best[j : j + n])
    return np.flatnonzero(best == grams)


@dataclass
class Grams:
    """Distinct grams of the items, sorted, with a place of each, and the items that have it. Grams that the same items have share a group."""

    gram: np.ndarray
    place: np.ndarray
    group: np.ndarray
    members: list[np.ndarray]

    @classmethod
    def of(cls, gram: np.ndarray, place: np.ndarray, item: np.ndarray) -> Grams:
        if not len(gram):
            return cls(gram, place, np.zeros(0, np.int64), [])
        order = np.lexsort((item, gram))
        gram, place, item = gram[order], place[order], item[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])
        gram, place, item = gram[fresh], place[fresh], item[fresh]
        head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        ends = np.append(head[1:], len(gram))
        signature = np.add.reduceat(ragged.mix(item.astype(np.uint64) + np.uint64(1)), head)
        _, one, group = np.unique(signature, return_index=True, return_inverse=True)
        return cls(gram[head], place[head], group, [item[head[k] : ends[k]] for k in one.tolist()])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted gram among these, -1 for none."""
        if not len(self.gram):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.gram, wanted), len(self.gram) - 1)
        return np.where(self.gram[at] == wanted, at, -1)


@dataclass
class Items:
    """Test items, ready to be looked up."""

    ids: list[str | None]
    word: np.ndarray  # word hashes of all items
    key: np.ndarray  # distinct fingerprints of the long items, sorted
    windows: Grams
    short: dict[int, Grams]  # by number of words

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Items:
        words = ragged.words_of(pa.array(texts, pa.string()), alnum=True)
        word, first = words.hashes(), words.first
        grams, key, starts, owner, short = ragged.gram_hashes(word, GRAM), [], [], [], {}
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a >= WINDOW:
                own = grams[a : b - GRAM + 1]
                key.append(own[fingerprints(own, WINDOW - GRAM + 1)])
                starts.append(np.arange(a, b - WINDOW + 1))
                owner.append(np.full(b - WINDOW + 1 - a, i))
            elif b > a:
                short.setdefault(b - a, []).append((a, i))
        key, starts, owner = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((key, np.uint64), (starts, np.int64), (owner, np.int64)))
        by_length = {m: (np.array([a for a, _ in v]), np.array([i for _, i in v])) for m, v in short.items()}
        short = {m: Grams.of(ragged.gram_hashes_at(word, at, m), at, i) for m, (at, i) in by_length.items()}
        return cls([None if i is None else str(i) for i in ids], word, np.unique(key), Grams.of(ragged.gram_hashes_at(word, starts, WINDOW), starts, owner), short)


def doc_fingerprints(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in all words) and hashes of the fingerprints of each document."""
    grams = ragged.gram_hashes(word, GRAM)
    if not len(grams):
        return np.arange(0), grams
    # grams that cross a document's end are no grams, and windows that hold one are no windows
    crossing = np.ones(len(word), bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    crossing[: len(grams)] = doc[: len(grams)] != doc[GRAM - 1 :]
    bounds = np.flatnonzero(crossing[: len(grams)])
    w = WINDOW - GRAM + 1
    if len(grams) < w:
        return np.arange(0), grams[:0]
    n = len(grams) - w + 1
    low = grams[:n].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : j + n], out=low)
    inside = np.zeros(len(grams) + 1, np.int64)
    inside[bounds + 1] = 1
    inside = np.cumsum(inside)
    whole = inside[w : w + n] == inside[:n]  # windows without a crossing gram
    best = np.zeros(len(grams), np.uint64)
    low = np.where(whole, low, np.uint64(0))
    for j in range(w):
        np.maximum(best[j : j + n], low, out=best[j : j + n])
    at = np.flatnonzero((best == grams) & ~crossing[: len(grams)])
    return at, grams[at]


def mark(word: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, list[set[int]]]:
    """Which words are hit, and the items that occur in each document."""
    cover, found = np.zeros(len(word) + 1, np.int32), [set() for _ in range(len(first) - 1)]

    def met(start: np.ndarray, grams: Grams, m: int) -> None:
        """Windows of m words at ``start``, in order, that are windows of items."""
        doc = np.searchsorted(first, start, side="right") - 1
        inside = start + m <= first[doc + 1]
        start, doc = start[inside], doc[inside]
        k = grams.find(ragged.gram_hashes_at(word, start, m))
        start, doc, k = start[k >= 0], doc[k >= 0], k[k >= 0]
        for j in range(m):
            same = word[start + j] == items.word[grams.place[k] + j]
            start, doc, k = start[same], doc[same], k[same]
        cover[start] += 1
        cover[start + m] -= 1
        for pair in np.unique(doc * len(grams.members) + grams.group[k]).tolist():
            found[pair // len(grams.members)].update(grams.members[pair % len(grams.members)].tolist())

    if len(items.key):
        at, key = doc_fingerprints(word, first)
        place = np.minimum(np.searchsorted(items.key, key), len(items.key) - 1)
        at = at[items.key[place] == key]
        start = np.unique(at[:, None] - np.arange(WINDOW - GRAM + 1))
        met(start[start >= 0], items.windows, WINDOW)
    for m, grams in items.short.items():
        met(np.arange(len(word)), grams, m)
    return np.cumsum(cover)[:-1] > 0, found


def _row(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, most: int, item_column: str, text_column: str) -> list[Items]:
    """The items in blocks of about ``most`` bytes of text; one empty block if there are none."""
    tests = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text")).distinct()
    size = tests.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    number = int(size) // most + 1
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(number)))
    rows = ((tests.where(F.col("block") == k) if number > 1 else tests).collect() for k in range(number))
    return [Items.of([r["item"] for r in own], [r["text"] for r in own]) for own in rows]


def contamination(documents: DataFrame, benchmark: DataFrame, most: int = MOST_BYTES, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; ``most``: bytes of item text in a block."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    blocks = _blocks(benchmark, most, item_column, item_text_column)
    for k, items in enumerate(blocks):
        rows = _marked(rows, items, k == 0, k == len(blocks) - 1)
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def _marked(rows: DataFrame, items: Items, begins: bool, ends: bool) -> DataFrame:
    """The documents with what earlier blocks and this one have found (bits of words that are hit, names of items), or after the last block their result."""
    held = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                words = ragged.words_of(part.column("text"), alnum=True)
                hit, found = mark(words.hashes(), words.first, held.value)
                names = [{held.value.ids[i] for i in f} - {None} for f in found]
                n, bounds = np.diff(words.first), list(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True))
                if not begins:
                    for d, ((a, b), bits, more) in enumerate(zip(bounds, part.column("hit").to_pylist(), part.column("names").to_pylist(), strict=True)):
                        hit[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                        names[d] |= set(more)
                if ends:
                    hits = np.concatenate(([0], np.cumsum(hit)))
                    columns = [pa.array(n, pa.int64()), pa.array(hits[words.first[1:]] - hits[words.first[:-1]], pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([_row(x) for x in names], pa.string())]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])
                else:
                    columns = [pa.array([np.packbits(hit[a:b]).tobytes() for a, b in bounds], pa.binary()), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *columns], ["doc_id", "text", "hit", "names"])

    return rows.mapInArrow(run, _SCHEMA if ends else "doc_id long, text string, hit binary, names array<string>")


def decontaminated(documents: DataFrame, benchmark: DataFrame, most: int = MOST_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no window of a test item.

    The marking runs in the projection of each row, so that texts are not shuffled to be filtered.
    """
    for items in _blocks(benchmark, most, "item_id", "text"):
        documents = _clean(documents, items, text_column)
    return documents


def _clean(documents: DataFrame, items: Items, text_column: str) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(items)
    at = documents.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{k}" for k in range(batch.num_columns)]
            for part in ragged.slices(pa.RecordBatch.from_arrays(batch.columns, names), f"c{at}"):
                words = ragged.words_of(part.column(at), alnum=True)
                hit, _ = mark(words.hashes(), words.first, held.value)
                hits = np.concatenate(([0], np.cumsum(hit)))
                clean = part.filter(pa.array(hits[words.first[1:]] == hits[words.first[:-1]]))
                yield pa.RecordBatch.from_arrays(clean.columns, schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)
