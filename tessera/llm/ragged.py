"""Words, shingles and their hashes for whole batches of texts, as ragged numpy arrays.

A batch of texts is one byte buffer with document offsets, as Arrow holds it. Nothing here loops over
bytes or words in Python: words are found by masks and hashed eight bytes at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_ALL = np.arange(256, dtype=np.uint8)
_ASCII_LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
# [^\x20\x09-\x0D]+ over bytes: UTF-8 continuation bytes are never separators
_SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over bytes, after A-Z were lower-cased
_ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def give_back() -> None:
    """Return freed memory to the system: a worker serves many operators, and its peaks would otherwise stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary array; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a run of documents: those of document d are first[d] to first[d + 1]."""

    data: np.ndarray  # bytes, lower-cased if asked for, padded by eight zeros
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word: its bytes in lanes of eight, with its length as the seed."""
        lanes = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        out = self.length.astype(np.uint64) * _STEP
        live, at, left = np.arange(len(out)), self.start, self.length
        while len(live):
            out[live] = mix(out[live] ^ (lanes[at] & _KEEP[np.minimum(left, 8)]))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return out

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k] + self.length[k]].tobytes()


def words_of(column: pa.Array, alnum: bool = False, lower: bool = False) -> Words:
    """alnum: runs of letters, digits and non-ASCII; otherwise whatever white space separates."""
    data, offsets = buffer_of(column)
    if alnum or lower:
        data = _ASCII_LOWER[data]
    inside = (_ALNUM if alnum else _SPACED)[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = False
    after[heads[(heads > 0)] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return Words(padded, start, end - start, np.searchsorted(start, offsets))


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of words i to i + n - 1 for each i; the last n - 1 places have none."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(word) - n + 1, n, np.uint64)
    for j in range(n):
        total = total + word[j : len(word) - n + 1 + j] * np.uint64(pow(int(_STEP), j + 1, 1 << 64))
    return mix(total)


def gram_hashes_at(word: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """``gram_hashes`` of the grams that begin at ``start``."""
    total = np.full(len(start), n, np.uint64)
    for j in range(n):
        total = total + word[start + j] * np.uint64(pow(int(_STEP), j + 1, 1 << 64))
    return mix(total)


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """For each document its sorted distinct n-word shingles; the whole sequence is one if it is shorter."""
    word, out = words.hashes(), []
    grams = gram_hashes(word, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(gram_hashes(word[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
