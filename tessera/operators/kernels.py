"""Block kernels that are loops by nature, over Arrow batches in numpy: all blocks of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLOURS, LEAST_RANGE, ROUNDS = 8, 48, 8


def matrix(column: pa.Array, width: int = 64) -> np.ndarray:
    """A column of arrays of equal length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def kmeans(v: np.ndarray) -> np.ndarray:
    """Centres of each row's values after ROUNDS rounds, seeded across the row's range."""
    lo, hi = v.min(1, keepdims=True).astype(float), v.max(1, keepdims=True).astype(float)
    centre = lo + (hi - lo) * (np.arange(COLOURS) + 0.5) / COLOURS
    for _ in range(ROUNDS):
        near = np.abs(v[:, :, None] - centre[:, None, :]).argmin(2)
        hit = near[:, :, None] == np.arange(COLOURS)
        n = hit.sum(1)
        centre = np.where(n > 0, (hit * v[:, :, None]).sum(1) / np.maximum(n, 1), centre)
    return centre


def palettes(blocks: DataFrame) -> DataFrame:
    """blk, n, colours: sorted colours of each block, null for one value or a small range: the distinct values
    if there are COLOURS at most, else rounded k-means centres without repeats."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            centres, out = np.floor(kmeans(v) + 0.5).astype(int), []
            for row, centre in zip(v, centres, strict=True):
                own = np.unique(row)
                if len(own) > COLOURS:
                    own = np.unique(centre)
                usable = len(own) >= 2 and int(row.max()) - int(row.min()) >= LEAST_RANGE
                out.append(own.tolist() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column("blk"), pa.array([None if c is None else len(c) for c in out], pa.int32()), pa.array([None if c is None else ",".join(map(str, c)) for c in out], pa.string())], ["blk", "n", "colours"])

    return blocks.mapInArrow(run, "blk long, n int, colours string")


def lfsr_noise(seed: int, n: int, bits: int = 11) -> np.ndarray:
    """The top bits of a 16-bit register with taps 0, 1, 3 and 12 after each of n shifts."""
    out, r = np.empty(n, np.int64), seed
    for k in range(n):
        r = (r >> 1) | (((r ^ r >> 1 ^ r >> 3 ^ r >> 12) & 1) << 15)
        out[k] = r >> (16 - bits)
    return out


def grain_template(seed: int, rows: int = 73, columns: int = 82, lag: int = 2, shift: int = 7) -> np.ndarray:
    """Noise filtered along the raster order: each sample takes an eighth of each of its neighbours before it,
    given here in place of a table; the register's centred values stand in for Gaussian ones."""
    grain = ((lfsr_noise(seed, rows * columns) - 1024) >> 2).reshape(rows, columns)
    taps = [(-dy, dx, 16 - 4 * (dy + abs(dx))) for dy in range(lag + 1) for dx in range(-lag, lag + 1) if dy or dx < 0]
    for y in range(lag, rows):
        for x in range(lag, columns - lag):
            total = sum(w * int(grain[y + dy, x + dx]) for dy, dx, w in taps)
            grain[y, x] = min(255, max(-256, int(grain[y, x]) + ((total + (1 << (shift - 1))) >> shift)))
    return grain


def grain_templates(frames: DataFrame) -> DataFrame:
    """frame, total, size: sums of each frame's template, seeded by its number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [grain_template((int(f) * 331 + 1) & 0xFFFF) for f in batch.column("frame").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("frame"), pa.array([int(g.sum()) for g in made], pa.int64()), pa.array([int(np.abs(g).sum()) for g in made], pa.int64())], ["frame", "total", "size"])

    return frames.mapInArrow(run, "frame long, total long, size long")


def fit_symmetric(source: np.ndarray, prediction: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Outer taps (three each, of 128) of the vertical and horizontal filters that bring a prediction to its source."""

    def spread(plane: np.ndarray, axis: int) -> list[np.ndarray]:
        """Sums of neighbours at distances 3, 2, 1 less twice the sample."""
        padded = np.pad(plane, [(3, 3) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        cut = lambda k: np.take(padded, np.arange(plane.shape[axis]) + 3 + k, axis)
        return [cut(-d) + cut(d) - 2 * plane for d in (3, 2, 1)]

    def apply(plane: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
        return plane + sum(t / 128 * s for t, s in zip(taps, spread(plane, axis), strict=True))

    taps = [np.zeros(3), np.zeros(3)]
    for _ in range(rounds):
        for axis in (0, 1):
            base = apply(prediction, taps[1 - axis], 1 - axis)
            a = np.stack([s.ravel() for s in spread(base, axis)], 1)
            found = np.linalg.lstsq(a.T @ a + 1e-6 * np.eye(3), a.T @ (source - base).ravel(), rcond=None)[0]
            taps[axis] = np.clip(np.round(found * 128), -64, 63)
    return taps[0], taps[1]


def wiener_fits(samples: DataFrame) -> DataFrame:
    """frame, v0 .. v2, h0 .. h2: fitted taps from rows (frame, y, x, s, r). A group is one frame."""
    names = [f"{a}{k}" for a in "vh" for k in range(3)]

    def fit(table: pa.Table) -> pa.Table:
        y, x, s, r = (table.column(c).to_numpy() for c in ("y", "x", "s", "r"))
        planes = []
        for values in (s, r):
            plane = np.zeros((y.max() + 1, x.max() + 1))
            plane[y, x] = values
            planes.append(plane)
        found = np.concatenate(fit_symmetric(*planes))
        return pa.table({"frame": table.column("frame")[:1], **{n: pa.array([int(v)], pa.int32()) for n, v in zip(names, found, strict=True)}})

    return samples.groupBy("frame").applyInArrow(fit, "frame long, " + ", ".join(f"{n} int" for n in names))


def recursive_intra(above: np.ndarray, left: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """8x8 prediction in units of 4x2 samples, each from seven neighbours by a table of taps (8 x 7, of 16)."""
    plane = np.zeros((9, 9), np.int64)
    plane[0], plane[1:, 0] = above, left
    for y in range(0, 8, 2):
        for x in range(0, 8, 4):
            edge = np.concatenate((plane[y, x : x + 5], plane[y + 1 : y + 3, x]))
            plane[y + 1 : y + 3, x + 1 : x + 5] = np.clip((taps @ edge + 8 >> 4).reshape(2, 4), 0, 255)
    return plane[1:, 1:]


def even_taps() -> np.ndarray:
    """Taps given in place of the format's table: each sample takes from the neighbours by nearness, 16 in all."""
    out = np.zeros((8, 7), np.int64)
    for k in range(8):
        y, x = divmod(k, 4)
        out[k, x + 1] += 8 - 2 * y
        out[k, 5 + y] += 8 + 2 * y
    return out


def recursive_predictions(edges: DataFrame) -> DataFrame:
    """blk, total, weighted of predictions from rows blk, above (9, with the corner), left (8)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taps = even_taps()
        for batch in batches:
            if batch.num_rows:
                made = [recursive_intra(a, l, taps) for a, l in zip(matrix(batch.column("above"), 9), matrix(batch.column("left"), 8), strict=True)]
                flat = np.stack(made).reshape(-1, 64)
                yield pa.RecordBatch.from_arrays([batch.column("blk"), pa.array(flat.sum(1)), pa.array(flat @ np.arange(64))], ["blk", "total", "weighted"])

    return edges.mapInArrow(run, "blk long, total long, weighted long")


def fast_search(target: np.ndarray, past: np.ndarray, y: int, x: int, reach: int = 4, moves: int = 8) -> tuple[int, int, int]:
    """Whole-sample vector by shrinking squares around the best so far, and its cost: differences plus 4 a step."""
    padded = np.pad(past, 2 * reach + 8, mode="edge")
    n = target.shape[0]

    def cost(v: tuple[int, int]) -> int:
        a, b = y + v[0] + 2 * reach + 8, x + v[1] + 2 * reach + 8
        return int(np.abs(target - padded[a : a + n, b : b + n]).sum()) + 4 * (abs(v[0]) + abs(v[1]))

    best, least, step = (0, 0), cost((0, 0)), reach // 2
    while step:
        for _ in range(moves):
            around = [(best[0] + dy * step, best[1] + dx * step) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
            found = min(((cost(v), k, v) for k, v in enumerate(around) if max(map(abs, v)) <= reach), default=(least, 0, best))
            if found[0] >= least:
                break
            least, best = found[0], found[2]
        step //= 2
    return best[0], best[1], least


def fast_searches(samples: DataFrame) -> DataFrame:
    """frame, by, bx, dy, dx, cost of each 8x8 block against the frame before: rows (frame, y, x, s, r), a group a frame."""

    def run(table: pa.Table) -> pa.Table:
        y, x, s, r = (table.column(c).to_numpy() for c in ("y", "x", "s", "r"))
        now, past = np.zeros((2, int(y.max()) + 1, int(x.max()) + 1), np.int64)
        now[y, x], past[y, x] = s, r
        rows = [(by, bx, *fast_search(now[8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8], past, 8 * by, 8 * bx)) for by in range(now.shape[0] // 8) for bx in range(now.shape[1] // 8)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        frame = pa.array([table.column("frame")[0].as_py()] * len(rows), pa.int64())
        return pa.Table.from_arrays([frame, *columns], ["frame", "by", "bx", "dy", "dx", "cost"])

    return samples.groupBy("frame").applyInArrow(run, "frame long, by long, bx long, dy long, dx long, cost long")


def warp(past: np.ndarray, y: int, x: int, matrix_16: tuple[int, int, int, int, int, int], n: int = 8) -> np.ndarray:
    """A block sampled along an affine map in 16-bit fixed point, bilinear between samples."""
    rows, columns = np.mgrid[y : y + n, x : x + n]
    a, b, c, d, e, f = matrix_16
    px, py = a + c * columns + d * rows, b + e * columns + f * rows
    ix, iy, fx, fy = px >> 16, py >> 16, px >> 8 & 255, py >> 8 & 255
    at = lambda dy, dx: past[np.clip(iy + dy, 0, past.shape[0] - 1), np.clip(ix + dx, 0, past.shape[1] - 1)]
    top, low = at(0, 0) * (256 - fx) + at(0, 1) * fx, at(1, 0) * (256 - fx) + at(1, 1) * fx
    return top * (256 - fy) + low * fy + (1 << 15) >> 16


def warps(samples: DataFrame) -> DataFrame:
    """frame, total, error: frames predicted by a small rotation of the frame before, block by block."""
    matrix_16 = (1 << 15, -(1 << 14), 1 << 16, 1 << 9, -(1 << 9), 1 << 16)

    def run(table: pa.Table) -> pa.Table:
        y, x, s, r = (table.column(c).to_numpy() for c in ("y", "x", "s", "r"))
        now, past = np.zeros((2, int(y.max()) + 1, int(x.max()) + 1), np.int64)
        now[y, x], past[y, x] = s, r
        made = np.block([[warp(past, by, bx, matrix_16) for bx in range(0, now.shape[1], 8)] for by in range(0, now.shape[0], 8)])
        return pa.table({"frame": table.column("frame")[:1], "total": pa.array([int(made.sum())], pa.int64()), "error": pa.array([int(np.abs(made - now).sum())], pa.int64())})

    return samples.groupBy("frame").applyInArrow(run, "frame long, total long, error long")


def directional(above: np.ndarray, left: np.ndarray, angle: int, slope: Callable[[int], int]) -> np.ndarray:
    """8x8 predictions of a stack of blocks along an angle (45 to 212 degrees); edges begin with the corner and have 16 more samples.

    slope: 64ths of a sample for an angle below 90 degrees.
    """
    i, j = np.mgrid[:8, :8]

    def between(edge: np.ndarray, at: np.ndarray) -> np.ndarray:
        base, part = np.minimum(at >> 6, 14), at >> 1 & 31
        return np.where(at >> 6 < 15, edge[:, base + 1] * (32 - part) + edge[:, base + 2] * part + 16 >> 5, edge[:, 16][:, None, None])

    if angle == 90:
        return np.broadcast_to(above[:, None, 1:9], (len(above), 8, 8))
    if angle == 180:
        return np.broadcast_to(left[:, 1:9, None], (len(left), 8, 8))
    if angle < 90:
        return between(above, (i + 1) * slope(angle) + 64 * j)
    if angle > 180:
        return between(left, (j + 1) * slope(270 - angle) + 64 * i)
    up, side = 64 * j - (i + 1) * slope(180 - angle), 64 * i - (j + 1) * slope(angle - 90)
    reached = up >> 6 >= -1
    return np.where(reached, between(above, np.where(reached, up, 0)), between(left, np.where(reached, 0, side)))


def directional_predictions(edges: DataFrame, angles: list[int], slope: Callable[[int], int]) -> DataFrame:
    """blk, angle, total, weighted: sums of the prediction of each block along each angle, from edges a and l."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                above, left = (matrix(batch.column(c), 17).astype(np.int64) for c in ("a", "l"))
                for angle in angles:
                    made = directional(above, left, angle, slope).reshape(-1, 64)
                    yield pa.RecordBatch.from_arrays([batch.column("blk"), pa.array([angle] * len(made), pa.int32()), pa.array(made.sum(1)), pa.array(made @ np.arange(1, 65))], ["blk", "angle", "total", "weighted"])

    return edges.mapInArrow(run, "blk long, angle int, total long, weighted long")
