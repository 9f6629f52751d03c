"""A small block codec over groups of pictures: the walk of a tile, its syntax elements and its reconstruction.

It exercises the walk that a tile coder makes (superblocks in raster order, a partition tree, modes, vectors,
residuals, with contexts from neighbours and distributions that adapt) on this library's own tables: equal
distributions at the start, a uniform quantiser and an orthonormal transform. Its streams are its own; they
are not those of a standard. Encoder and decoder share one walk (``Walk``), where coding a symbol either
writes a decision or reads it, so that both reconstruct the same samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators.blocks import basis
from tessera.operators.coder import Decoder, Distribution, Encoder

SUPERBLOCK, LEAST = 16, 4
MODES = ("dc", "vertical", "horizontal", "paeth", "inter")
REACH, LEVELS = 3, 15
_BASIS = {n: np.array(basis(n)) for n in (4, 8, 16)}
_SCAN = {n: np.array([i * n + j for i, j in sorted(((i, j) for i in range(n) for j in range(n)), key=lambda p: (p[0] + p[1], p[0]))]) for n in (4, 8, 16)}


class Walk:
    """One picture's walk. With ``source`` it decides and writes, without it reads."""

    def __init__(self, coder: Encoder | Decoder, height: int, width: int, step: float, past: np.ndarray | None, source: np.ndarray | None):
        self.coder, self.step, self.past, self.source = coder, step, past, source
        self.out = np.zeros((height, width), np.int64)
        self.models: dict[tuple, Distribution] = {}
        self.mode_of = np.full((height // LEAST + 1, width // LEAST + 1), -1)
        self.skip_of = np.zeros_like(self.mode_of)

    def code(self, name: str, n: int, value: int, *context: int) -> int:
        model = self.models.setdefault((name, n, *context), Distribution.flat(n))
        if isinstance(self.coder, Decoder):
            return self.coder.symbol(model)
        self.coder.symbol(model, value)
        return value

    def frame(self) -> np.ndarray:
        height, width = self.out.shape
        for y in range(0, height, SUPERBLOCK):
            for x in range(0, width, SUPERBLOCK):
                self.tree(y, x, SUPERBLOCK)
        return self.out

    def tree(self, y: int, x: int, size: int) -> None:
        height, width = self.out.shape
        if y >= height or x >= width:
            return
        inside = y + size <= height and x + size <= width
        split = int(not inside)
        if inside and size > LEAST:
            split = self.code("split", 2, self.wants_split(y, x, size), size, *self.near(self.skip_of, y, x))
        if split:
            for dy in (0, size // 2):
                for dx in (0, size // 2):
                    self.tree(y + dy, x + dx, size // 2)
        else:
            self.block(y, x, size)

    def near(self, grid: np.ndarray, y: int, x: int) -> tuple[int, int]:
        """Values above and to the left, -1 beyond the picture."""
        r, c = y // LEAST, x // LEAST
        return int(grid[r - 1, c]) if r else -1, int(grid[r, c - 1]) if c else -1

    def wants_split(self, y: int, x: int, size: int) -> int:
        """Detail beyond what the step keeps, which the quarters have less of."""
        if self.source is None:
            return 0
        part = self.source[y : y + size, x : x + size]
        h = size // 2
        quarters = np.mean([part[a : a + h, b : b + h].var() for a in (0, h) for b in (0, h)])
        whole, q = part.var(), self.step**2
        return int(whole > 0.6 * q and (quarters < 0.75 * whole or whole > 4 * q))

    def predict(self, mode: str, y: int, x: int, size: int, vector: tuple[int, int] = (0, 0)) -> np.ndarray:
        if mode == "inter":
            rows = np.clip(np.arange(y, y + size) + vector[0], 0, self.past.shape[0] - 1)
            columns = np.clip(np.arange(x, x + size) + vector[1], 0, self.past.shape[1] - 1)
            return self.past[np.ix_(rows, columns)]
        above = self.out[y - 1, x : x + size] if y else None
        left = self.out[y : y + size, x - 1] if x else None
        if mode == "dc" or above is None or left is None:
            edges = [e for e in (above, left) if e is not None]
            return np.full((size, size), (sum(int(e.sum()) for e in edges) + len(edges) * size // 2) // (len(edges) * size) if edges else 128)
        if mode == "vertical":
            return np.tile(above, (size, 1))
        if mode == "horizontal":
            return np.tile(left[:, None], (1, size))
        corner = int(self.out[y - 1, x - 1])
        base = above[None, :] + left[:, None] - corner
        distance = np.stack([np.abs(base - left[:, None]), np.abs(base - above[None, :]), np.abs(base - corner)])
        choice = distance.argmin(0)  # the first one on ties: left, above, corner
        return np.where(choice == 0, left[:, None], np.where(choice == 1, above[None, :], corner))

    def search(self, y: int, x: int, size: int) -> tuple[int, tuple[int, int]]:
        """Mode and vector with the least difference; the first on ties. Vectors by shrinking steps around the best."""
        target = self.source[y : y + size, x : x + size]
        cost = lambda mode, v=(0, 0): int(np.abs(target - self.predict(mode, y, x, size, v)).sum())
        found = [(cost(m), k, (0, 0)) for k, m in enumerate(MODES[:4])]
        if self.past is not None:
            best, reach = (0, 0), 2
            while reach:
                around = [(best[0] + dy * reach, best[1] + dx * reach) for dy in (0, -1, 1) for dx in (0, -1, 1)]
                best = min((v for v in around if max(map(abs, v)) <= REACH), key=lambda v: (cost("inter", v), around.index(v)))
                reach //= 2
            found.append((cost("inter", best), 4, best))
        _, mode, vector = min(found)
        return mode, vector

    def block(self, y: int, x: int, size: int) -> None:
        mode, vector = self.search(y, x, size) if self.source is not None else (0, (0, 0))
        modes = len(MODES) if self.past is not None else len(MODES) - 1
        mode = self.code("mode", modes, mode, *self.near(self.mode_of, y, x))
        if MODES[mode] == "inter":
            vector = tuple(self.code(f"vector{k}", 2 * REACH + 1, v + REACH) - REACH for k, v in enumerate(vector))
        prediction = self.predict(MODES[mode], y, x, size, vector)
        matrix, levels = _BASIS[size], np.zeros(size * size, np.int64)
        if self.source is not None:
            c = matrix @ (self.source[y : y + size, x : x + size] - prediction) @ matrix.T / self.step
            dead = np.full(c.shape, 0.38)
            dead[0, 0] = 0.5
            levels = (np.sign(c) * np.floor(np.abs(c) + dead)).astype(np.int64).ravel()[_SCAN[size]]
        levels = self.residual(levels, size, y, x)
        flat = np.zeros(size * size)
        flat[_SCAN[size]] = levels * self.step
        # rounded to a sixteenth first, so that the last bits of products do not decide
        residual = np.floor(np.round(matrix.T @ flat.reshape(size, size) @ matrix * 16) / 16 + 0.5).astype(np.int64)
        self.out[y : y + size, x : x + size] = np.clip(prediction + residual, 0, 255)
        cells = np.s_[y // LEAST : (y + size) // LEAST, x // LEAST : (x + size) // LEAST]
        self.mode_of[cells], self.skip_of[cells] = mode, int(not levels.any())

    def residual(self, levels: np.ndarray, size: int, y: int, x: int) -> np.ndarray:
        """Levels in scan order: whether there are any, the place of the last one, sizes with an escape, signs."""
        used = np.flatnonzero(levels)
        if self.code("skip", 2, int(not len(used)), size, *self.near(self.skip_of, y, x)):
            return np.zeros(size * size, np.int64)
        last = int(used[-1]) + 1 if len(used) else 0
        kind = self.code("last", 9, max(last - 1, 0).bit_length(), size)  # its number of bits, then the bits
        bits = max(kind - 1, 0)
        last = (1 << kind - 1 | self.literal(last - 1 & (1 << bits) - 1, bits) if kind else 0) + 1
        out, before = np.zeros(size * size, np.int64), 0
        for k in range(last):
            value = int(levels[k])
            magnitude = self.code("level", LEVELS + 1, min(abs(value), LEVELS), size, min(k, 3), min(before, 2))
            if magnitude == LEVELS:
                magnitude += self.golomb(abs(value) - LEVELS)
            if magnitude:
                out[k] = -magnitude if self.literal(int(value < 0), 1) else magnitude
            before = magnitude
        return out

    def literal(self, value: int, n: int) -> int:
        if isinstance(self.coder, Decoder):
            return self.coder.literal(n)
        self.coder.literal(value, n)
        return value

    def golomb(self, value: int) -> int:
        n = 0
        if not isinstance(self.coder, Decoder):
            n = (value + 1).bit_length() - 1
            self.coder.literal(1, n + 1)
            self.coder.literal(value + 1 - (1 << n), n)
            return value
        while not self.coder.literal(1):
            n += 1
        return (1 << n) + self.coder.literal(n) - 1


def encode(frames: list[np.ndarray], step: float) -> tuple[bytes, list[np.ndarray]]:
    """A group of pictures as one stream, and its reconstruction: the first picture by itself, others after the one before."""
    coder, past, out = Encoder(), None, []
    for frame in frames:
        past = Walk(coder, *frame.shape, step, past, frame).frame()
        out.append(past)
    return coder.finish(), out


def decode(data: bytes, count: int, height: int, width: int, step: float) -> list[np.ndarray]:
    coder, past, out = Decoder(data), None, []
    for _ in range(count):
        past = Walk(coder, height, width, step, past, None).frame()
        out.append(past)
    return out


def coded_groups(samples: DataFrame, group: int, step: float) -> DataFrame:
    """gop, frames, bytes, same, error: pictures (frame, y, x, s) coded in groups, each by itself: whether decoding gives
    the encoder's reconstruction, and the squared error to the source."""

    def run(table: pa.Table) -> pa.Table:
        f, y, x, s = (table.column(c).to_numpy() for c in ("frame", "y", "x", "s"))
        first, height, width = int(f.min()), int(y.max()) + 1, int(x.max()) + 1
        frames = np.zeros((int(f.max()) - first + 1, height, width), np.int64)
        frames[f - first, y, x] = s
        data, made = encode(list(frames), step)
        back = decode(data, len(frames), height, width, step)
        same = all(np.array_equal(a, b) for a, b in zip(made, back, strict=True))
        error = int(((np.array(made) - frames) ** 2).sum())
        return pa.table({"gop": table.column("gop")[:1], "frames": pa.array([len(frames)], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "same": pa.array([same]), "error": pa.array([error], pa.int64())})

    rows = samples.selectExpr("frame", "y", "x", "s", f"frame div {group} as gop")
    return rows.groupBy("gop").applyInArrow(run, "gop long, frames long, bytes long, same boolean, error long")


def block_table(samples: DataFrame, step: float) -> DataFrame:
    """frame, mi_row, mi_col, mode, skip: what the walk of each picture by itself decides for its 4x4 blocks."""

    def run(table: pa.Table) -> pa.Table:
        y, x, s = (table.column(c).to_numpy() for c in ("y", "x", "s"))
        frame = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.int64)
        frame[y, x] = s
        walk = Walk(Encoder(), *frame.shape, step, None, frame)
        walk.frame()
        rows, columns = np.indices(walk.mode_of[:-1, :-1].shape)
        n = rows.size
        return pa.table({"frame": pa.array(np.repeat(table.column("frame")[0].as_py(), n)), "mi_row": pa.array(rows.ravel()), "mi_col": pa.array(columns.ravel()), "mode": pa.array([MODES[m] for m in walk.mode_of[:-1, :-1].ravel()]), "skip": pa.array(walk.skip_of[:-1, :-1].ravel() > 0)})

    return samples.select("frame", "y", "x", "s").groupBy("frame").applyInArrow(run, "frame long, mi_row long, mi_col long, mode string, skip boolean")


