"""Inverse transforms in 12-bit fixed point, as programs that run over stacks of vectors and that SQL can spell out.

A program is a list of stages, and a stage gives each place of a vector a weighted sum of places, rounded by 12 bits
where the weights are cosines. The cosine transform is made of halves: the even inputs are a transform of half the
length, the odd ones turn against each other, level by level, and both meet in sums and differences. Angles are in
128ths of a half turn. The sine transform (of 8 and 16) turns pairs of its ends and then halves, quarters and so on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: By place: the weights and places of the sum, and whether it is rounded by 12 bits.
Stage = dict[int, tuple[list[tuple[int, int]], bool]]

#: sin(k pi / 9) * 2 * sqrt(2) / 3 * 4096, and the square roots of two and of one half in 12 bits.
SINPI = (1321, 2482, 3344, 3803)
ROOT_HALF = 2896


def cos128(angle: int) -> int:
    """4096 cos(pi angle / 128), rounded."""
    x = 4096 * math.cos(math.pi * angle / 128)
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def sin128(angle: int) -> int:
    return cos128(angle - 64)


def reverse(k: int, bits: int) -> int:
    """The lowest bits of k in reverse order."""
    return sum((k >> b & 1) << (bits - 1 - b) for b in range(bits))


def _turn(a: int, b: int, angle: int, swap: bool) -> Stage:
    """Places a and b turned by an angle, and exchanged if ``swap``."""
    c, s = cos128(angle), sin128(angle)
    x, y = ([(c, a), (-s, b)], True), ([(s, a), (c, b)], True)
    return {a: y, b: x} if swap else {a: x, b: y}


def _meet(a: int, b: int) -> Stage:
    """Sum in a, difference in b."""
    return {a: ([(1, a), (1, b)], False), b: ([(1, a), (-1, b)], False)}


def _all(parts: Iterable[Stage]) -> Stage:
    out: Stage = {}
    for p in parts:
        out |= p
    return out


def _moved(sources: list[tuple[int, int]]) -> Stage:
    """Place k gets sign times the place that the k-th pair (sign, place) names."""
    return {k: ([(sign, place)], False) for k, (sign, place) in enumerate(sources)}


def _even(base: int, size: int) -> list[Stage]:
    if size == 2:
        return [_turn(base, base + 1, 32, True)]
    halves = zip_longest(_even(base, size // 2), _odd(base + size // 2, size // 2), fillvalue={})
    return [a | b for a, b in halves] + [_all(_meet(base + k, base + size - 1 - k) for k in range(size // 2))]


def _odd(base: int, m: int) -> list[Stage]:
    """The m odd inputs of a transform of 2 m, in bit-reversed order. An input of frequency f is 64 f / 2 m from the half turn."""

    def angle(k: int, n: int) -> int:
        return 64 - (2 * reverse(k, (n // 2).bit_length() - 1) + 1) * 64 // n

    out = [_all(_turn(base + k, base + m - 1 - k, angle(k, 2 * m), False) for k in range(m // 2))]
    span = 2
    while span <= m // 2:
        # groups of a span meet in themselves, every other one upside down; then what is inside pairs of groups turns
        pairs = [(base + g * span + k, base + (g + 1) * span - 1 - k, g % 2) for g in range(m // span) for k in range(span // 2)]
        out.append(_all(_meet(b, a) if down else _meet(a, b) for a, b, down in pairs))
        inside = [k for k in range(m // 2) if span // 2 <= k % (2 * span) < 3 * span // 2]
        out.append(_all(_turn(base + m - 1 - k, base + k, angle(k // (2 * span), m // span) + (64 if k % (2 * span) >= span else 0), True) for k in inside))
        span *= 2
    return out


def inverse_dct(n: int) -> list[Stage]:
    """The inverse cosine transform of 4, 8, 16, 32 or 64 values, the square root of n / 2 times the orthonormal one."""
    return [_moved([(1, reverse(k, n.bit_length() - 1)) for k in range(n)]), *_even(0, n)]


def inverse_adst(n: int) -> list[Stage]:
    """The inverse sine transform of 4, 8 or 16 values; of 4 values it is of another kind, and one stage."""
    if n == 4:
        s1, s2, s3, s4 = SINPI
        rows = ((s1, s3, s4, s2), (s2, s3, -s1, -s4), (s3, 0, -s3, s3), (s1 + s2, -s3, s4 - s1, s2 - s4))
        return [{k: ([(w, j) for j, w in enumerate(row) if w], True) for k, row in enumerate(rows)}]
    out = [_moved([(1, n - 1 - k if k % 2 == 0 else k - 1) for k in range(n)])]
    out.append(_all(_turn(2 * k, 2 * k + 1, 64 - (4 * k + 1) * 32 // n, True) for k in range(n // 2)))
    half = n // 2
    while half >= 2:
        out.append(_all(_meet(start + k, start + half + k) for start in range(0, n, 2 * half) for k in range(half)))
        turns = []
        for start in range(half, n, 2 * half):
            if half == 2:
                turns.append(_turn(start, start + 1, 32, True))
            for k in range(half // 4):
                turn = (4 * k + 1) * 64 // half
                turns.append(_turn(start + 2 * k, start + 2 * k + 1, 64 - turn, True))
                turns.append(_turn(start + half // 2 + 2 * k + 1, start + half // 2 + 2 * k, turn, True))
        out.append(_all(turns))
        half //= 2
    bits = n.bit_length() - 1
    return [*out, _moved([(-1 if k % 2 else 1, reverse(k ^ k >> 1, bits)) for k in range(n)])]


KINDS: dict[str, Callable[[int], list[Stage]]] = {"dct": inverse_dct, "adst": inverse_adst}


def run(program: list[Stage], x: np.ndarray) -> np.ndarray:
    """The program over the rows of a matrix of 64-bit integers."""
    columns = [x[:, k] for k in range(x.shape[1])]
    for stage in program:
        made = list(columns)
        for k, (terms, rounded) in stage.items():
            total = sum(w * columns[j] for w, j in terms)
            made[k] = total + 2048 >> 12 if rounded else total
        columns = made
    return np.stack(columns, 1)


def walsh(x: np.ndarray, shift: int) -> np.ndarray:
    """The lossless transform over the rows of a matrix of four columns."""
    first, second, third, fourth = (x[:, k] >> shift for k in range(4))
    total, gap = first + second, third - fourth
    half = total - gap >> 1
    low, high = half - fourth, half - second
    return np.stack((total - low, low, high, gap + high), 1)


def inverse_2d(x: np.ndarray, row: list[Stage], column: list[Stage], row_shift: int, depth: int = 8) -> np.ndarray:
    """Rows, then columns, of a stack of blocks: inputs and what is between in depth + 8 bits, blocks twice as long as wide scaled by the root of one half."""
    blocks, height, width = x.shape
    limit = 1 << depth + 7
    x = np.clip(x, -limit, limit - 1)
    if 2 * min(height, width) == max(height, width):
        x = x * ROOT_HALF + 2048 >> 12
    rows = run(row, x.reshape(-1, width)).reshape(blocks, height, width)
    rows = np.clip(rows + (1 << row_shift >> 1) >> row_shift, -limit, limit - 1)
    columns = run(column, np.swapaxes(rows, 1, 2).reshape(-1, height)).reshape(blocks, width, height)
    return np.swapaxes(columns + 8 >> 4, 1, 2)


def digests(blocks: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """blk, total, weighted: sums of what a function makes of a stack of blocks d of 64 numbers, all of a batch at once."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = batch.column("d").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 64)
                out = function(d).reshape(len(d), 64)
                yield pa.RecordBatch.from_arrays([batch.column("blk"), pa.array(out.sum(1)), pa.array(out @ np.arange(1, 65))], ["blk", "total", "weighted"])

    return blocks.select("blk", "d").mapInArrow(of, "blk long, total long, weighted long")


def cells(d: np.ndarray, height: int, width: int) -> np.ndarray:
    """Blocks of 64 as parts of a height and a width, in raster order."""
    return d.reshape(-1, 8 // height, height, 8 // width, width).swapaxes(2, 3).reshape(-1, height, width)


def spelled(program: list[Stage], n: int, source: str, keys: str, name: str) -> tuple[str, str]:
    """SQL of a program over the columns t0, t1, ... of a relation, a common table expression a stage, and the last one's name."""
    parts = []
    for step, stage in enumerate(program):
        columns = []
        for k in range(n):
            terms, rounded = stage.get(k, ([(1, k)], False))
            total = " + ".join(f"({w}) * t{j}" for w, j in terms)
            columns.append(f"({total} + 2048) >> 12 AS t{k}" if rounded else f"{total} AS t{k}")
        parts.append(f"{name}{step} AS (SELECT {keys}, {', '.join(columns)} FROM {source})")
        source = f"{name}{step}"
    return ", ".join(parts), source
