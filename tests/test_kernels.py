"""Kernels against slow writings of what they stand for, and transforms against the functions that they approach."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import adapters as A
from tessera.operators import coder, coefficients, frames, kernels, presets, streams, transforms as T
from tessera.plans import registry


@pytest.mark.parametrize("n", [4, 8, 16, 32, 64])
def test_inverse_cosine_transforms(n):
    x = np.random.default_rng(n).integers(-2000, 2000, (40, n))
    basis = np.array([[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)])
    program = T.inverse_dct(n)  # half a unit a stage, and the cosines' own rounding, 2000 / 8192 for each input
    assert np.abs(T.run(program, x) - x @ basis * math.sqrt(n / 2)).max() < 0.25 * n + 0.5 * len(program)


@pytest.mark.parametrize("n", [4, 8, 16])
def test_inverse_sine_transforms(n):
    x = np.random.default_rng(n).integers(-2000, 2000, (40, n))
    if n == 4:
        basis = np.array([[2 * math.sqrt(2) / 3 * math.sin(math.pi * (i + 1) * (2 * k + 1) / 9) for i in range(n)] for k in range(n)])
    else:
        basis = np.array([[math.sin(math.pi * (2 * i + 1) * (2 * k + 1) / (4 * n)) for i in range(n)] for k in range(n)])
    program = T.inverse_adst(n)
    assert np.abs(T.run(program, x) - x @ basis).max() < 0.25 * n + 0.5 * len(program)


def test_walsh_gives_back_what_its_butterflies_took():
    """Against the forward transform, written as the inverse's steps backwards."""
    rng = np.random.default_rng(1)
    values = rng.integers(-255, 256, (50, 4))
    a, b, c, d = values.T
    a1, d1 = a + b, d - c
    e = a1 - d1 >> 1
    b1, c1 = e - b, e - c
    coded = np.stack((a1 - c1, c1, d1 + b1, b1), 1)
    assert np.array_equal(T.walsh(coded * 4, 2), values)


def test_flat_blocks_stay_flat():
    block = np.zeros((1, 8, 8), np.int64)
    block[0, 0, 0] = 800
    assert len(np.unique(T.inverse_2d(block, T.inverse_dct(8), T.inverse_dct(8), 1))) == 1


def test_levels_come_back_and_zeros_are_cheap():
    rng = random.Random(2)
    blocks = [[0] * 64] + [[rng.choice([0, 0, 0, 1, -1, 2, -5, 14, 15, -16, 300, -(1 << 20) + 1]) if rng.random() < share else 0 for _ in range(64)] for share in (0.02, 0.1, 0.5, 1.0) for _ in range(12)]
    data = coefficients.encoded(blocks)
    assert coefficients.decoded(data, len(blocks)) == blocks
    assert len(coefficients.encoded([[0] * 64] * 400)) < 10
    for _ in range(20):  # any bytes are levels, as far as they go
        found = coefficients.Walk(coder.Decoder(rng.randbytes(40) + b"\xff" * 400))
        assert len(found.block()) == 64


def slow_recursive(above, left, taps):
    plane = {(-1, x - 1): int(v) for x, v in enumerate(above)} | {(y, -1): int(v) for y, v in enumerate(left)}
    for y0 in range(0, 8, 2):
        for x0 in range(0, 8, 4):
            edge = [plane[y0 - 1, x0 + k] for k in range(-1, 4)] + [plane[y0, x0 - 1], plane[y0 + 1, x0 - 1]]
            for k in range(8):
                total = sum(int(taps[k][j]) * edge[j] for j in range(7))
                plane[y0 + k // 4, x0 + k % 4] = min(255, max(0, (total + 8) >> 4))
    return np.array([[plane[y, x] for x in range(8)] for y in range(8)])


def test_recursive_prediction():
    rng = np.random.default_rng(3)
    taps = kernels.even_taps()
    assert (taps.sum(1) == 16).all()
    for _ in range(10):
        above, left = rng.integers(0, 256, 9), rng.integers(0, 256, 8)
        assert np.array_equal(kernels.recursive_intra(above, left, taps), slow_recursive(above, left, taps))


def test_directional_prediction_of_straight_lines():
    """Edges that are one plane's samples are continued along each direction: a gradient across it comes out flat along it."""
    slope = lambda a: math.floor(64 / math.tan(math.radians(a)) + 0.5)
    above, left = np.full((1, 17), 70), np.full((1, 17), 70)
    for angle in (45, 60, 90, 100, 135, 170, 180, 200, 212):
        assert (kernels.directional(above, left, angle, slope) == 70).all()
    rising = np.arange(17)[None, :] * 8
    made = kernels.directional(rising, rising, 45, slope)[0]
    assert np.array_equal(made[:7, :7], [[8 * (i + j + 2) for j in range(7)] for i in range(7)])


def test_warp_is_bilinear():
    rng = np.random.default_rng(4)
    past, m = rng.integers(0, 256, (40, 80)), (1 << 15, -(1 << 14), (1 << 16) + 700, 1 << 9, -(1 << 9), (1 << 16) - 300)
    made = kernels.warp(past, 16, 24, m)
    at = lambda y, x: int(past[min(max(y, 0), 39), min(max(x, 0), 79)])
    for i in range(8):
        for j in range(8):
            px, py = m[0] + m[2] * (24 + j) + m[3] * (16 + i), m[1] + m[4] * (24 + j) + m[5] * (16 + i)
            x, y, fx, fy = px >> 16, py >> 16, px >> 8 & 255, py >> 8 & 255
            top, low = at(y, x) * (256 - fx) + at(y, x + 1) * fx, at(y + 1, x) * (256 - fx) + at(y + 1, x + 1) * fx
            assert made[i, j] == (top * (256 - fy) + low * fy + 32768) >> 16
    assert np.array_equal(kernels.warp(past, 8, 8, (0, 0, 1 << 16, 0, 0, 1 << 16)), past[8:16, 8:16])


def test_fast_search_is_bounded_by_the_full_one():
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:40, :80]
    past = (128 + 60 * np.sin(x / 6) + 40 * np.cos(y / 5)).astype(np.int64)
    now = frames.moved(past, 2, -3) + rng.integers(-2, 3, past.shape)
    full = frames.motion(now, past, 4, 4)
    for by, bx in ((1, 1), (2, 4), (3, 8)):
        dy, dx, cost = kernels.fast_search(now[8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8], past, 8 * by, 8 * bx)
        assert cost >= full["cost"][by, bx] and cost == np.abs(now - frames.moved(past, dy, dx))[8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8].sum() + 4 * (abs(dy) + abs(dx))


def test_symmetric_fits_find_the_filter_that_made_the_source():
    rng = np.random.default_rng(6)
    past = rng.integers(0, 256, (40, 80)).astype(float)
    vertical, horizontal = kernels.fit_symmetric(past + 12 / 128 * sum(np.roll(past, k, 1) - past for k in (-1, 1)), past)
    assert abs(horizontal[2] - 12) <= 1 and np.abs(vertical).max() <= 1


def slow_grain(seed, rows, columns):
    r, grain = seed, []
    for _ in range(rows * columns):
        bit = (r ^ r >> 1 ^ r >> 3 ^ r >> 12) & 1
        r = r >> 1 | bit << 15
        grain.append(((r >> 5) - 1024) >> 2)
    for y in range(2, rows):
        for x in range(2, columns - 2):
            total = 0
            for dy in (0, 1, 2):
                for dx in range(-2, 3):
                    if dy or dx < 0:
                        total += (16 - 4 * (dy + abs(dx))) * grain[(y - dy) * columns + x + dx]
            grain[y * columns + x] = min(255, max(-256, grain[y * columns + x] + ((total + 64) >> 7)))
    return grain


def test_grain_templates():
    assert kernels.grain_template(332).ravel().tolist() == slow_grain(332, 73, 82)


def test_still_pictures_do_not_move():
    plane = np.random.default_rng(7).integers(0, 256, (16, 24))
    found = frames.motion(plane, plane, 2, 4)
    assert not found["dy"].any() and not found["dx"].any() and not found["cost"].any()


def test_wide_filters_smooth_a_step_and_leave_edges_of_objects():
    line = np.array([[100] * 8 + [104] * 8, [20] * 8 + [220] * 8])
    for size, changed in ((4, 4), (6, 4), (8, 6), (16, 12)):
        out = frames.edge_lines(line, size, 20, 60, 2, 1)
        assert 0 < (out[0] != line[0]).sum() <= changed and (np.diff(out[0]) >= 0).all() and np.array_equal(out[1], line[1])


def test_presets():
    assert len(presets.switches(4)) == 32 and presets.switches(99) == presets.switches(10)
    own = presets.changed(presets.switches(0), "tx_types", 99)
    assert own["tx_types"] == 16 and presets.changed(own, "aq", 1)["aq"] is True
    with pytest.raises(KeyError):
        presets.changed(own, "none", 1)
    with pytest.raises(ValueError):
        presets.Settings(0, 10)


def test_settings_are_a_struct(spark):
    row = spark.range(1).select(presets.Settings(64, 48).column().alias("s")).first()["s"]
    assert row["speed"] == presets.DEFAULT_SPEED and len(row) == len(presets.SETTINGS)


def test_round_trips_without_sql_hold(spark, data):
    """Sinks and writers against readers: every row must say so."""
    queries = registry.queries()
    assert queries["a11_y4m_sink"](spark, data).where("not same").count() == 0
    assert queries["b15_frame_header_write"](spark, data).where("same is null and error is null or not same").count() == 0
    assert queries["b12_film_grain"](spark, data).where("same is null and error is null or not same").count() == 0


def test_palettes_hold_the_colours_of_small_blocks(spark, data):
    found = {r.blk: (r.n, r.colours) for r in registry.queries()["k14_palette_kmeans"](spark, data).collect()}
    blocks = {r.blk: r.v for r in A.blocks(spark, data).collect()}
    assert found.keys() == blocks.keys()
    for blk, v in blocks.items():
        n, colours = found[blk]
        if max(v) - min(v) < 48:
            assert n is None
        elif len(set(v)) <= 8:
            assert colours == ",".join(map(str, sorted(set(v))))
        else:
            assert 2 <= n <= 8 and all(min(v) <= int(c) <= max(v) for c in colours.split(","))


@pytest.mark.parametrize("top", [255, 200, 1])
def test_finest_step_tries_a_step_for_each_bit(spark, top):
    """The first step within the budget, or the last one; costs that are null are within none. Not every step is tried."""
    budgets = [(k, None if k == 7 else float(13**k % 4001 - 40)) for k in range(60)]
    rows = spark.createDataFrame(budgets, "k int, a double")
    found = {r.k: r.q for r in rows.select("k", streams.finest_step(lambda q: F.col("a") / F.pow(q, F.lit(1.3)), F.lit(2.0), top).alias("q")).collect()}
    assert found == {k: next((q for q in range(1, top + 1) if a is not None and a / q**1.3 <= 2.0), top) for k, a in budgets}
    assert "sequence" not in rows.select(streams.finest_step(lambda q: F.col("a") / q, F.lit(2.0), top))._jdf.queryExecution().analyzed().toString()
