"""Token counts of whole texts by rank-synchronous byte-pair merging in numpy.

Pre-tokens that were not counted before are laid out as one ragged array of symbols. In each round every
sequence finds the lowest rank among its adjacent pairs and merges all non-overlapping occurrences of that
pair at once; sequences without a known pair are finished, and what is left of them is their count. That
equals merging one pair at a time: a pair that a merge creates has a higher rank than the merge itself.

Nulls and edge cases: null and empty texts have no bytes and no tokens; equal rows are counted alike; an
empty table gives no rows; other columns of the input, whatever their names, are ignored. A text's
pre-tokens are counted whole, whatever their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm import ragged

#: Fixed value: the pre-token pattern that the ByteLevel pre-tokeniser of these files stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 400_000
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file["pre_tokenizer"] or {}
        if file["model"]["type"] != "BPE" or file.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError("a byte-level BPE file that splits by its own pattern, without a normaliser or a prefix space, is needed")
        vocabulary = file["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        left, right, merged = (np.array([vocabulary[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], "".join))
        if len(np.unique(merged)) < len(merged):
            raise ValueError("two merges make the same token: their ranks do not tell what merges next")
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.merged = key[order], order.astype(np.int64), merged
        self.byte = np.array([vocabulary[c] for c in byte_symbols()], np.int64)
        self.words = regex.compile(PATTERN)
        special = [t["content"] for t in file.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def _ranks(self, symbol: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        key = symbol[pairs] << 32 | symbol[pairs + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive merging, for each sequence of bytes."""
        size = np.array([len(s) for s in sequences], np.int64)
        out = size.copy()
        symbol = self.byte[np.frombuffer(b"".join(sequences), np.uint8)]
        live = np.flatnonzero(size > 1)
        symbol = symbol[np.repeat(size > 1, size)]
        size = size[live]
        while len(live):
            ends = np.cumsum(size)
            starts, owner = ends - size, np.repeat(np.arange(len(size)), size)
            rank = np.full(len(symbol), NONE)
            inner = np.ones(len(symbol), bool)
            inner[ends - 1] = False
            pairs = np.flatnonzero(inner)
            rank[pairs] = self._ranks(symbol, pairs)
            least = np.minimum.reduceat(rank, starts)
            hit = (rank == least[owner]) & (rank != NONE)
            # a pair of equal symbols may overlap with the next one: every second of a run is merged
            run_start = hit.copy()
            run_start[1:] &= ~hit[:-1]
            place = np.arange(len(symbol))
            first = np.maximum.accumulate(np.where(run_start, place, 0))
            hit &= (place - first) % 2 == 0
            at = np.flatnonzero(hit)
            symbol[at] = self.merged[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            size = size - np.bincount(owner[at], minlength=len(size))
            out[live] = size
            goes_on = (least != NONE) & (size > 1)
            symbol = symbol[stays & goes_on[owner]]
            live, size = live[goes_on], size[goes_on]
        return out

    def count_texts(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for t in texts:
            parts = self.special.split(t) if self.special and self.special.search(t) else [t]
            split.append(self.words.findall(t) if len(parts) == 1 else [w for p in parts for w in self.words.findall(p)])
            extra.append(len(parts) - 1)
        distinct = set().union(*split)
        if len(self.known) + len(distinct) > CACHED:
            self.known = {}
        if new := [w for w in distinct if w not in self.known]:
            self.known.update(zip(new, self.count([w.encode() for w in new]).tolist(), strict=True))
        return [e + sum(map(self.known.__getitem__, words)) for e, words in zip(extra, split, strict=True)]


_TABLES: dict[str, MergeTable] = {}


def count_tokens(documents: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TABLES:
            _TABLES[path] = MergeTable(path)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                n = _TABLES[path].count_texts([t or "" for t in part.column("text").to_pylist()])
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
