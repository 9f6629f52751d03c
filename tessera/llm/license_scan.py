"""License scans: exact set-similarity join of text blocks with license templates.

Blocks are windows of words, as many as a template has, over the threshold, so that the length filter holds both
ways; \\n-split lines with no more words are blocks themselves. As notices are wrapped, windows go over line ends; a
line of one word is an item of its own, whose end no window crosses. A template is a set of words; a block meets it when it holds at
least THRESHOLD of the template's words. Words are ordered by the number of documents of the whole table
that hold them, rarest first. A block that meets a template of s words holds one of the first
s - ceil(t s) + 1 words of the template (prefix filter), has ceil(t s) words or more (length filter), and,
read in the global order, has enough of both sets left after each shared word (positional filter). Only
blocks that pass the prefix filter are looked at word by word.

The base labels are found as phrases: places where the words of a phrase stand consecutively.

Result: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. The score is 1 with a
base phrase, else the largest share of a template that a block holds if that reaches the threshold, else 0.

Nulls and edge cases: null and wordless texts have no words, no places, empty label strings and score 0;
equal rows get equal results; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import ragged

THRESHOLD = (8, 10)
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as their licenses' owners recommend or as they are commonly written.
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"],
    "apache-2": ["licensed under the apache license version 2 0", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["this library is free software licensed under the gnu lesser general public license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["all rights reserved"],
}


def _hashes(text: str) -> np.ndarray:
    return ragged.words_of(pa.array([text]), alnum=True).hashes()


@dataclass
class Phrases:
    """Phrases as word hashes with their labels."""

    items: list[tuple[np.ndarray, str]]

    def places(self, word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase stands within one document, and which."""
        at, which = [], []
        for k, (phrase, _) in enumerate(self.items):
            n = len(word) - len(phrase) + 1
            if n <= 0:
                continue
            found = np.flatnonzero(word[:n] == phrase[0])
            for j in range(1, len(phrase)):
                found = found[word[found + j] == phrase[j]]
            found = found[doc[found] == doc[found + len(phrase) - 1]]
            at.append(found)
            which.append(np.full(len(found), k))
        return (np.concatenate(at), np.concatenate(which)) if at else (np.arange(0), np.arange(0))


@dataclass
class Templates:
    """Template words as ranks in the global order, rarest first."""

    words: np.ndarray  # sorted hashes of all template words
    rank: np.ndarray  # of each of them
    sets: list[tuple[str, np.ndarray]]  # label, sorted ranks
    threshold: tuple[int, int]
    lengths: list[int]  # words of each template, repeated ones too

    @classmethod
    def of(cls, templates: dict[str, list[str]], counts: dict[int, int], threshold: tuple[int, int]) -> Templates:
        words = vocabulary(templates)
        order = sorted(range(len(words)), key=lambda k: (counts.get(k, 0), int(words[k])))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        sets = [(label, np.unique(rank[np.searchsorted(words, _hashes(t))])) for label, texts in templates.items() for t in texts]
        return cls(words, rank, sets, threshold, [len(_hashes(t)) for texts in templates.values() for t in texts])

    def __post_init__(self):
        p, q = self.threshold
        self.needed = [-(-p * len(s) // q) for _, s in self.sets]
        self.windows = [-(-n * q // p) for n in self.lengths]
        self.by_prefix: dict[int, list[int]] = {}
        for k, (_, s) in enumerate(self.sets):
            for r in s[: len(s) - self.needed[k] + 1].tolist():
                self.by_prefix.setdefault(r, []).append(k)
        self.is_prefix = np.zeros(len(self.words) + 1, bool)
        self.is_prefix[list(self.by_prefix)] = True

    def ranks(self, word: np.ndarray) -> np.ndarray:
        """Rank of each word that a template has, else len(words)."""
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, self.rank[at], len(self.words))

    def windowed(self, rank: np.ndarray, hits: np.ndarray) -> dict[str, float]:
        """Labels of the templates that a window of a run of words meets; hits: places of prefix words in the run."""
        found: dict[str, float] = {}
        near: dict[int, list[int]] = {}
        for at in hits.tolist():
            for k in self.by_prefix[int(rank[at])]:
                near.setdefault(k, []).append(at)
        for k, places in near.items():
            (label, template), size = self.sets[k], self.windows[k]
            reach = np.zeros(len(rank) + 1, np.int64)  # windows that hold a prefix word
            np.add.at(reach, np.maximum(np.array(places) - size + 1, 0), 1)
            np.add.at(reach, np.minimum(np.array(places) + size, len(rank)), -1)
            mine = np.flatnonzero(np.isin(rank, template) & (np.cumsum(reach)[:-1] > 0)).tolist()
            inside: dict[int, int] = {}
            first = best = 0
            for at in mine:  # the window that ends here
                inside[rank[at]] = inside.get(rank[at], 0) + 1
                while at - mine[first] >= size:
                    gone = rank[mine[first]]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    first += 1
                best = max(best, len(inside))
            if best >= self.needed[k]:
                found[label] = max(found.get(label, 0.0), best / len(template))
        return found

    def met(self, block: list[int], n_words: int, length: int = 0) -> dict[str, float]:
        """Labels of the templates that a block meets; block: its sorted distinct template ranks; length: its words, repeated ones too."""
        found: dict[str, float] = {}
        for k in sorted({t for r in block for t in self.by_prefix.get(r, ())}):
            label, template = self.sets[k]
            need = self.needed[k]
            if n_words < need or length > self.windows[k]:
                continue
            i = j = shared = 0
            while i < len(block) and j < len(template) and shared + min(len(block) - i, len(template) - j) >= need:
                a, b = block[i], template[j]
                shared += a == b
                i, j = i + (a <= b), j + (b <= a)
            if shared >= need:
                found[label] = max(found.get(label, 0.0), shared / len(template))
        return found


def vocabulary(templates: dict[str, list[str]]) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for texts in templates.values() for t in texts]))


def document_frequencies(texts: DataFrame, words: np.ndarray) -> dict[int, int]:
    """By place in ``words``: the documents of the whole table that hold the word. At most one row a word is collected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                found = ragged.words_of(part.column("text"), alnum=True)
                word = found.hashes()
                at = np.minimum(np.searchsorted(words, word), len(words) - 1)
                mine = np.flatnonzero(words[at] == word)
                doc = np.searchsorted(found.first, mine, side="right") - 1
                pairs = np.unique(doc * len(words) + at[mine])
                total += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)), pa.int32()), pa.array(total)], ["word", "n"])

    rows = texts.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def scan(documents: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, threshold: tuple[int, int] = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Licenses of every document."""
    base = Phrases([(_hashes(p), label) for p, label in (phrases or PHRASES).items()])
    templates = templates or TEMPLATES
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    known = Templates.of(templates, document_frequencies(texts.select("text"), vocabulary(templates)), threshold)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                yield _scanned(part, base, known)

    return texts.mapInArrow(run, schema)


def _scanned(part: pa.RecordBatch, base: Phrases, known: Templates) -> pa.RecordBatch:
    words = ragged.words_of(part.column("text"), alnum=True)
    word, first, docs = words.hashes(), words.first, part.num_rows
    doc = np.repeat(np.arange(docs), np.diff(first))
    at, which = base.places(word, doc)
    n_base = np.bincount(doc[at], minlength=docs)
    lows: list[int | None] = [None] * docs
    highs: list[int | None] = [None] * docs
    base_labels: list[set[str]] = [set() for _ in range(docs)]
    for place, k in sorted(zip(at.tolist(), which.tolist(), strict=True)):
        d = int(doc[place])
        own = place - int(first[d])
        lows[d] = own if lows[d] is None else lows[d]
        highs[d] = own
        base_labels[d].add(base.items[k][1])
    labels, score = [set(x) for x in base_labels], [1.0 if x else 0.0 for x in base_labels]

    rank = known.ranks(word)
    hits = np.flatnonzero(known.is_prefix[rank])
    if len(hits):
        breaks = np.flatnonzero(words.data[:-8] == 10)
        head = first[:-1][np.diff(first) > 0]
        line = np.searchsorted(breaks, words.start) + np.searchsorted(head, np.arange(len(word)), side="right")
        for number in np.unique(line[hits]).tolist():
            a, b = np.searchsorted(line, [number, number + 1])
            block = np.unique(rank[a:b])
            block = block[block < len(known.words)].tolist()
            d = int(doc[a])
            for label, share in known.met(block, len(np.unique(word[a:b])), int(b - a)).items():
                labels[d].add(label)
                score[d] = max(score[d], share)
        lone = np.bincount(line)[line] == 1
        ends = np.flatnonzero((line[1:] != line[:-1]) & ((doc[1:] != doc[:-1]) | lone[:-1]))
        run = np.searchsorted(ends + 1, np.arange(len(word)), side="right")
        for number in np.unique(run[hits]).tolist():
            a, b = np.searchsorted(run, [number, number + 1])
            d = int(doc[a])
            for label, share in known.windowed(rank[a:b], hits[(hits >= a) & (hits < b)] - a).items():
                labels[d].add(label)
                score[d] = max(score[d], share)
    text = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(n_base, pa.int64()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), text(base_labels), text(labels), pa.array(score, pa.float64())],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    )
