import numpy as np

from tessera.operators import tiles


def pictures(seed, n, height, width):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    return [np.clip(128 + 60 * np.sin((x + 2 * k) / 9) + 30 * np.cos(y / 7) + rng.normal(0, 4, (height, width)), 0, 255).astype(np.int64) for k in range(n)]


def test_decoding_gives_the_reconstruction():
    for seed, (height, width) in enumerate([(16, 16), (40, 80), (20, 36), (4, 4), (32, 12)]):
        frames = pictures(seed, 3, height, width)
        for step in (1.0, 8.0, 40.0):
            data, made = tiles.encode(frames, step)
            back = tiles.decode(data, 3, height, width, step)
            assert all(np.array_equal(a, b) for a, b in zip(made, back, strict=True))


def test_coarser_steps_take_fewer_bytes_and_keep_less():
    frames = pictures(9, 3, 32, 64)
    sizes, errors = [], []
    for step in (2.0, 6.0, 18.0, 54.0):
        data, made = tiles.encode(frames, step)
        sizes.append(len(data))
        errors.append(float(np.mean([(a - b) ** 2 for a, b in zip(made, frames, strict=True)])))
    assert sizes == sorted(sizes, reverse=True) and errors == sorted(errors)


def test_vectors_follow_motion():
    frames = pictures(4, 1, 32, 64)
    moved = [frames[0], np.roll(frames[0], 2, 1)]
    still = [frames[0], np.random.default_rng(1).permutation(frames[0].ravel()).reshape(32, 64)]
    assert len(tiles.encode(moved, 4.0)[0]) < 0.75 * len(tiles.encode(still, 4.0)[0])
