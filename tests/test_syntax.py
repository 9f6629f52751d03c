import random

import pytest
from hypothesis import given, settings, strategies as st

from tessera.sources import syntax as X
from tessera.sources.containers import Malformed, Unsupported


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=400, max_size=400))
def test_sequence_headers_written_and_read_are_the_same(data):
    data = bytes([data[0] % 3 << 5 | data[0] & 31]) + data[1:]
    header = X.read(X.sequence_header, data)
    assert X.read(X.sequence_header, X.write(X.sequence_header, header)) == header


def test_frame_headers_written_and_read_are_the_same():
    rng, done, faults = random.Random(1), 0, 0
    for _ in range(400):
        s = X.read(X.sequence_header, bytes([rng.randrange(3) << 5]) + rng.randbytes(400))
        s.update(reduced=0, width_bits=9, height_bits=9, max_width=rng.randrange(16, 900), max_height=rng.randrange(16, 900))
        slots = [None] * 8
        for k in range(5):
            try:
                h = X.read(X.frame_header, bytes([0x10 if k == 0 else 0x30 | rng.randrange(16)]) + rng.randbytes(600), s, slots)
            except Malformed:
                faults += 1
                continue
            assert X.read(X.frame_header, X.write(X.frame_header, h, s, slots), s, slots) == h
            done += 1
            slots = [h if not h["show_existing"] and h["refresh"] >> i & 1 else old for i, old in enumerate(slots)]
    assert done > 400 and faults < 1600


def test_faults_are_named():
    with pytest.raises(Unsupported):
        X.read(X.sequence_header, b"\xe0" * 20)
    with pytest.raises(Malformed):
        X.read(X.sequence_header, b"\x00")
    with pytest.raises(Malformed):
        X.tile_sizes(b"\xff\xff", 2, 2)
    with pytest.raises(ValueError):
        X.Bits().bits(4, 2)


def test_codes_of_numbers():
    for value in [*range(70), 1000, 2**20, 2**31]:
        out, back = X.Bits(), {}
        out.uvlc({"v": value}, "v")
        assert X.Bits(out.data()).uvlc(back, "v") == value
    for n in (1, 2, 3, 5, 8, 100):
        for value in range(n):
            out = X.Bits()
            out.ns({"v": value}, "v", n)
            assert X.Bits(out.data()).ns({}, "v", n) == value
    for low, high in ((0, 9), (-5, 6), (-64, 65), (0, 200)):
        for ref in (low, high - 1, (low + high) // 2):
            for value in range(low, high):
                out = X.Bits()
                out.subexp({"v": value}, "v", low, high, ref)
                assert X.Bits(out.data()).subexp({}, "v", low, high, ref) == value
    assert X.skip_frames([3, 5, 9, 12], 8, 4) == (1, 2) and X.skip_frames([3, 5, 5], 8, 4) == (0, 1) and X.skip_frames([8], 8, 4) is None
