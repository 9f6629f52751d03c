import random

import numpy as np
from hypothesis import given, settings, strategies as st

from tessera.operators import coder, kernels, quality


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 16), st.lists(st.integers(0, 15), max_size=300))
def test_decoding_is_the_inverse_of_encoding(n, symbols):
    symbols = [s % n for s in symbols]
    data = coder.encoded(symbols, n)
    decoder, distribution = coder.Decoder(data), coder.Distribution.flat(n)
    assert [decoder.symbol(distribution) for _ in symbols] == symbols
    assert decoder.closed()


def test_mixed_symbols_bits_and_bounded_numbers():
    rng = random.Random(4)
    writer, model, log = coder.Encoder(), coder.Distribution.flat(7), []
    for _ in range(2000):
        kind, v = rng.randrange(3), rng.randrange(7)
        log.append((kind, v))
        writer.symbol(model, v) if kind == 0 else writer.literal(v, 3) if kind == 1 else writer.below(v, 7)
    reader, model = coder.Decoder(writer.finish()), coder.Distribution.flat(7)
    assert [(k, reader.symbol(model) if k == 0 else reader.literal(3) if k == 1 else reader.below(7)) for k, _ in log] == log


def test_skewed_streams_are_short():
    assert len(coder.encoded([0] * 4000, 5)) < 4000 // 8 // 4


def test_any_bytes_decode():
    rng = random.Random(5)
    for _ in range(50):
        decoder, model = coder.Decoder(rng.randbytes(rng.randrange(0, 20))), coder.Distribution.flat(5)
        assert all(0 <= decoder.symbol(model) < 5 for _ in range(100))


def test_kmeans_and_symmetric_fit_and_delta_rate():
    v = np.array([[10] * 20 + [200] * 30 + [90] * 14])
    assert {10.0, 90.0, 200.0} <= set(np.round(kernels.kmeans(v)[0], 6))
    rng = np.random.default_rng(1)
    plane = rng.normal(0, 30, (40, 60))
    vertical, horizontal = kernels.fit_symmetric(plane, plane)
    assert not vertical.any() and not horizontal.any()
    points = np.array([[100.0, 30.0], [200.0, 33.0], [400.0, 36.0], [900.0, 39.0]])
    assert abs(quality.delta_rate(points, points * [0.8, 1]) + 20) < 1e-6
    assert np.isnan(quality.delta_rate(points, points + [0, 50]))
