"""Levels of a block as symbols: where they end, their sizes from the last one to the first, and signs.

One walk codes and reads: with an encoder it writes the levels that it is given, with a decoder it finds them. Sizes
up to 2 are one symbol, up to 14 as many as five, and beyond them follows an exponential code. Distributions adapt
over the blocks of a stream, and their contexts are the sizes of the neighbours that are known: those to the right
and below. Distributions begin equal, as this library has no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.operators.blocks import N, diagonal_scan
from tessera.operators.coder import Decoder, Distribution, Encoder

BASE, STEP, STEPS = 3, 3, 4  # the first size that more symbols follow, what each of them adds at most, and how many there are
SCAN = diagonal_scan()


@dataclass
class Walk:
    coder: Encoder | Decoder
    models: dict[tuple, Distribution] = field(default_factory=dict)

    @property
    def reads(self) -> bool:
        return isinstance(self.coder, Decoder)

    def symbol(self, n: int, value: int, *context) -> int:
        model = self.models.setdefault(context, Distribution.flat(n))
        if self.reads:
            return self.coder.symbol(model)
        self.coder.symbol(model, value)
        return value

    def bits(self, n: int, value: int) -> int:
        if self.reads:
            return self.coder.literal(n)
        self.coder.literal(value, n)
        return value

    def beyond(self, value: int) -> int:
        """A number from 0 on: as many zeros as its bits are more than one, and then the bits."""
        size = (value + 1).bit_length()
        if self.reads:
            size = 1
            while not self.coder.literal(1):
                size += 1
            return (1 << size - 1 | self.coder.literal(size - 1)) - 1
        self.coder.literal(0, size - 1)
        self.coder.literal(value + 1, size)
        return value

    def end(self, last: int) -> int:
        """One more than the place of the last level that is not zero: its class, and the place in the class."""
        kind = self.symbol(7, (last - 1).bit_length() if last else 0, "end")
        return kind + 1 if kind < 2 else 1 + (1 << kind - 1) + self.bits(kind - 1, last - 1 - (1 << kind - 1) if last else 0)

    def size(self, value: int, last: bool, near: int) -> int:
        found = self.symbol(BASE, min(value, BASE) - 1, "last", near) + 1 if last else self.symbol(BASE + 1, min(value, BASE), "size", near)
        if found < BASE:
            return found
        for _ in range(STEPS):
            more = self.symbol(STEP + 1, min(value - found, STEP), "more", near)
            found += more
            if more < STEP:
                return found
        return found + self.beyond(value - found)

    def block(self, levels: list[int] | None = None) -> list[int]:
        own = levels or [0] * N * N
        last = max((k + 1 for k, p in enumerate(SCAN) if own[p]), default=0)
        out = [0] * N * N
        if not self.symbol(2, int(last > 0), "any"):
            return out
        last = self.end(last)
        for k in range(last - 1, -1, -1):
            p = SCAN[k]
            row, column = divmod(p, N)
            around = sum(min(out[(row + dy) * N + column + dx], BASE) for dy, dx in ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0)) if row + dy < N and column + dx < N)
            out[p] = self.size(abs(own[p]), k == last - 1, min(around + 1 >> 1, 4))
        for k in range(last):
            p = SCAN[k]
            if out[p] and (self.symbol(2, int(own[p] < 0), "sign") if k == 0 else self.bits(1, int(own[p] < 0))):
                out[p] = -out[p]
        return out


def encoded(blocks: list[list[int]]) -> bytes:
    walk = Walk(Encoder())
    for levels in blocks:
        walk.block(levels)
    return walk.coder.finish()


def decoded(data: bytes, blocks: int) -> list[list[int]]:
    walk = Walk(Decoder(data))
    return [walk.block() for _ in range(blocks)]


def coded(levels: DataFrame) -> DataFrame:
    """blk, levels as read back, bytes (of the frame's stream): blocks of a frame (blk, frame, l) are one stream."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("blk")
        blocks = pc.list_flatten(table.column("l").combine_chunks()).to_numpy().reshape(-1, N * N).tolist()
        data = encoded(blocks)
        back = np.array(decoded(data, len(blocks)), np.int64)
        offsets = pa.array(np.arange(len(blocks) + 1) * N * N, pa.int32())
        return pa.table({"blk": table.column("blk"), "levels": pa.ListArray.from_arrays(offsets, pa.array(back.ravel())), "bytes": pa.array([len(data)] * len(blocks), pa.int64())})

    return levels.groupBy("frame").applyInArrow(run, "blk long, levels array<long>, bytes long")
