"""Quality measures, rate-distortion curves and verdicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LEAST_POINTS = 4


def psnr(error: Column, samples: Column, top: float = 255.0) -> Column:
    """Signal to noise in dB of a summed squared error; the mean is 1e-10 at least."""
    return 10 * F.log10(top * top / F.greatest(error.cast("double") / samples, F.lit(1e-10)))


def psnr_yuv(y: Column, u: Column, v: Column) -> Column:
    return (6 * y + u + v) / 8


def cubic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least-squares cubic through points, lowest power first, about x = 0."""
    middle, spread = x.mean(), max(float(np.ptp(x)), 1e-9)
    scaled = np.linalg.lstsq(((x - middle) / spread)[:, None] ** np.arange(4), y, rcond=None)[0]
    return np.polynomial.polynomial.Polynomial(scaled, domain=[middle - spread, middle + spread], window=[-1, 1]).convert(kind=np.polynomial.polynomial.Polynomial).coef


def _curves(x: np.ndarray, y: np.ndarray):
    return np.polynomial.polynomial.Polynomial.fit(x, y, 3)


def delta_rate(base: np.ndarray, test: np.ndarray) -> float:
    """Mean difference in rate, in per cent, over the common range of quality; NaN without one. Points: (bytes, quality)."""
    lo, hi = max(base[:, 1].min(), test[:, 1].min()), min(base[:, 1].max(), test[:, 1].max())
    if hi <= lo:
        return float("nan")
    area = [(c := _curves(p[:, 1], np.log(p[:, 0])).integ())(hi) - c(lo) for p in (base, test)]
    return (float(np.exp((area[1] - area[0]) / (hi - lo))) - 1) * 100


def cubic_fits(points: DataFrame) -> DataFrame:
    """clip, c0 .. c3: log rate as a cubic of quality. A group is the points of a clip."""

    def run(table: pa.Table) -> pa.Table:
        rate, quality = table.column("bytes").to_numpy().astype(float), table.column("psnr").to_numpy()
        ok = rate > 0
        c = np.zeros(4) if ok.sum() < LEAST_POINTS else np.resize(np.append(cubic(quality[ok], np.log(rate[ok])), np.zeros(4)), 4)
        return pa.table({"clip": table.column("clip")[:1], **{f"c{k}": pa.array([float(v)]) for k, v in enumerate(c)}})

    return points.groupBy("clip").applyInArrow(run, "clip string, c0 double, c1 double, c2 double, c3 double")


def bd_rates(points: DataFrame) -> DataFrame:
    """clip, bd_rate of encoder ``test`` against ``base``, for clips with LEAST_POINTS points of each."""

    def run(table: pa.Table) -> pa.Table:
        encoder = np.array(table.column("encoder").to_pylist())
        both = np.stack((table.column("bytes").to_numpy().astype(float), table.column("psnr").to_numpy()), 1)
        base, test = both[encoder == "base"], both[encoder == "test"]
        enough = min(len(base), len(test)) >= LEAST_POINTS
        clip = table.column("clip")[: 1 if enough else 0]
        return pa.table({"clip": clip, "bd_rate": pa.array([delta_rate(base, test)] if enough else [], pa.float64())})

    return points.select("clip", "encoder", F.col("bytes").cast("double").alias("bytes"), "psnr").groupBy("clip").applyInArrow(run, "clip string, bd_rate double")


def verdicts(expected: DataFrame, found: DataFrame, key: str, place: str) -> DataFrame:
    """frames, expected, matched, first_failure of each key: digests joined on both sides' places."""
    both = expected.join(found, [key, place], "full_outer")
    same = F.col("expected").eqNullSafe(F.col("found"))
    return both.groupBy(key).agg(F.count("found").alias("frames"), F.count("expected").alias("expected"), F.count(F.when(same, 1)).alias("matched"), F.min(F.when(~same, F.col(place))).alias("first_failure"))
