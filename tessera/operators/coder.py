"""Adaptive multi-symbol arithmetic coding of streams, a stream a group (strictly sequential by nature).

The interval's low end is an integer of any length, so that carries need no handling; its width has 16 bits.
A distribution is a list of rising cumulative probabilities in 2^15ths, the last one 32768, and a count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators.streams import flat_cdf

#: Probabilities lose 6 bits in products, and each symbol keeps a least width of 4.
LOSS, LEAST = 6, 4


@dataclass
class Distribution:
    cdf: list[int]
    count: int = 0

    @classmethod
    def flat(cls, n: int) -> Distribution:
        return cls(flat_cdf(n))

    def adapt(self, symbol: int) -> None:
        n = len(self.cdf)
        rate = 3 + (self.count > 15) + (self.count > 31) + min(n.bit_length() - 1, 2)
        self.cdf = [c + ((32768 - c) >> rate) if k >= symbol else c - (c >> rate) for k, c in enumerate(self.cdf[:-1])] + [32768]
        self.count = min(self.count + 1, 32)

    def bound(self, width: int, symbol: int) -> int:
        """Distance from the interval's top to the end of a symbol's part."""
        if symbol < 0:
            return width
        rest = (32768 - self.cdf[symbol]) >> LOSS
        return ((width >> 8) * rest >> (7 - LOSS)) + LEAST * (len(self.cdf) - symbol - 1)


def even() -> Distribution:
    """An equiprobable bit, which does not adapt."""
    return Distribution([16384, 32768])


@dataclass
class Encoder:
    low: int = 0
    width: int = 1 << 15
    shifts: int = 0

    def symbol(self, distribution: Distribution, symbol: int, adapt: bool = True) -> None:
        top, end = distribution.bound(self.width, symbol - 1), distribution.bound(self.width, symbol)
        self.low += self.width - top
        self.width = top - end
        d = 16 - self.width.bit_length()
        self.low, self.width, self.shifts = self.low << d, self.width << d, self.shifts + d
        if adapt:
            distribution.adapt(symbol)

    def literal(self, value: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            self.symbol(even(), value >> k & 1, False)

    def below(self, value: int, n: int) -> None:
        """A number below n in w - 1 or w bits."""
        w = n.bit_length()
        m = (1 << w) - n
        if n <= 1:
            return
        if value < m:
            self.literal(value, w - 1)
        else:
            self.literal((value + m) >> 1, w - 1)
            self.literal((value + m) & 1, 1)

    def finish(self) -> bytes:
        """The shortest value of the interval that ends in a one bit, filled up with zeros to whole bytes."""
        mask = (1 << 14) - 1
        code = ((self.low + mask) & ~mask | 1 << 14) >> 14
        n = self.shifts + 1
        return (code << -n % 8).to_bytes((n + 7) // 8, "big")


@dataclass
class Decoder:
    data: bytes
    width: int = 1 << 15
    at: int = 15
    value: int = field(init=False)

    def __post_init__(self):
        self.bits = int.from_bytes(self.data, "big")
        self.size = 8 * len(self.data)
        self.value = 32767 - self._take(0, 15)

    def _take(self, at: int, n: int) -> int:
        """n bits from bit ``at``; zeros beyond the end."""
        spare = self.size - at - n
        return (self.bits >> spare if spare >= 0 else self.bits << -spare) & ((1 << n) - 1)

    def symbol(self, distribution: Distribution, adapt: bool = True) -> int:
        symbol, top = 0, self.width
        while self.value < (end := distribution.bound(self.width, symbol)):
            symbol, top = symbol + 1, end
        self.width, self.value = top - end, self.value - end
        d = 16 - self.width.bit_length()
        self.value = ((self.value + 1 << d) - 1) ^ self._take(self.at, d)
        self.width, self.at = self.width << d, self.at + d
        if adapt:
            distribution.adapt(symbol)
        return symbol

    def literal(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = 2 * value + self.symbol(even(), False)
        return value

    def below(self, n: int) -> int:
        if n <= 1:
            return 0
        w = n.bit_length()
        m = (1 << w) - n
        value = self.literal(w - 1)
        return value if value < m else 2 * value - m + self.literal(1)

    def closed(self) -> bool:
        """Whether the data ends as an encoder ends it: a one bit where decoding stopped, then zeros."""
        end = self.at - 14  # bits that the last symbol's interval has fixed, and the closing one
        if end > self.size or end < 1:
            return False
        return self._take(end - 1, 1) == 1 and self._take(end, self.size - end) == 0


def encoded(symbols: list[int], n: int) -> bytes:
    coder, distribution = Encoder(), Distribution.flat(n)
    for s in symbols:
        coder.symbol(distribution, s)
    return coder.finish()


def encode_streams(rows: DataFrame, key: str, order: str, symbol: str, n: int) -> DataFrame:
    """key, symbols, size, data: each stream's symbols in order under one adapting distribution, and its bytes as a container states them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        values = table.column(symbol).to_pylist()
        data = encoded(values, n)
        return pa.table({key: table.column(key)[:1], "symbols": pa.array([len(values)], pa.int64()), "size": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    return rows.select(key, order, symbol).groupBy(key).applyInArrow(run, f"{key} long, symbols long, size long, data binary")


def decode_streams(streams: DataFrame, key: str, n: int) -> DataFrame:
    """key, place, symbol, closed: the symbols of each row's data, and whether it ends as it should.

    The closing bit alone does not tell: some streams without their last bytes, or with more of them, are streams of as
    many other symbols. So data that is not as long as stated (size) is not closed either.
    """

    def run(batches):
        for batch in batches:
            keys, places, out, closed = [], [], [], []
            for k, count, size, data in zip(*(batch.column(c).to_pylist() for c in (key, "symbols", "size", "data")), strict=True):
                coder, distribution = Decoder(data), Distribution.flat(n)
                out += [coder.symbol(distribution) for _ in range(count)]
                keys += [k] * count
                places += range(count)
                closed += [len(data) == size and coder.closed()] * count
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(out, pa.int32()), pa.array(closed, pa.bool_())], [key, "place", "symbol", "closed"])

    return streams.select(key, "symbols", "size", "data").mapInArrow(run, f"{key} long, place long, symbol int, closed boolean")
