"""The encoder's switches by speed, and its settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOWEST, FASTEST, DEFAULT_SPEED = 0, 10, 4

#: The last speed at which a switch is on, the first one, those that no speed changes, and numbers by the last speed that has them.
UNTIL = {"rdo": 8, "partition_rect": 5, "partition_4x4": 1, "rd_skip": 8, "tx_size": 7, "tx_type_rd": 6, "full_tx_set": 3, "cdef": 9, "cdef_thorough": 3, "lf_search": 9, "multi_ref": 6, "cfl": 8, "restoration": 8, "restoration_thorough": 2, "compound": 5, "palette": 8}
FROM = {"prune_split": 3, "fast_me": 5, "fast_tx_refine": 5, "restoration_fast": 5, "rd_skip_best": 5, "prune_intra": 5, "wavefront": 5}
ALWAYS = {"prune_partition": False, "abandon_trials": True, "aq": False}
NUMBERS = {
    "tx_types": ((1, 16), (3, 7), (6, 5), (10, 4)),
    "intra_candidates": ((1, 5), (4, 3), (6, 2), (10, 1)),
    "inter_candidates": ((1, 5), (4, 3), (6, 2), (10, 1)),
    "split_threshold": ((4, 0), (10, 15)),
    "split_threshold_small": ((4, 0), (5, 100), (10, 200)),
    "tx_depth_max": ((5, 2), (10, 1)),
}
MOST = {"tx_types": 16, "intra_candidates": 13, "inter_candidates": 16, "split_threshold": 65535, "split_threshold_small": 65535, "tx_depth_max": 2}


def switches(speed: int) -> dict[str, bool | int]:
    """All switches at a speed; speeds beyond the fastest are the fastest."""
    speed = min(max(speed, SLOWEST), FASTEST)
    found: dict[str, bool | int] = {name: speed <= last for name, last in UNTIL.items()}
    found |= {name: speed >= first for name, first in FROM.items()} | ALWAYS
    return found | {name: next(v for last, v in steps if speed <= last) for name, steps in NUMBERS.items()}


def changed(own: dict[str, bool | int], name: str, value: int) -> dict[str, bool | int]:
    """The switches with one set by name: numbers up to their bound, all others on unless the value is 0. KeyError for other names."""
    if name not in own:
        raise KeyError(name)
    return own | {name: min(value, MOST[name]) if name in MOST else value != 0}


def table(spark: SparkSession) -> DataFrame:
    """speed and a column a switch, for joins."""
    s = F.col("speed")

    def number(steps: tuple[tuple[int, int], ...]) -> Column:
        out = F.lit(steps[-1][1])
        for last, value in reversed(steps[:-1]):
            out = F.when(s <= last, value).otherwise(out)
        return out

    columns = {n: s <= last for n, last in UNTIL.items()} | {n: s >= first for n, first in FROM.items()} | {n: F.lit(v) for n, v in ALWAYS.items()} | {n: number(v) for n, v in NUMBERS.items()}
    return spark.range(FASTEST + 1).select(F.col("id").cast("int").alias("speed")).select("speed", *[c.alias(n) for n, c in columns.items()])


@dataclass(frozen=True)
class Settings:
    """What a stream is made with; broadcast as a struct where expressions need it."""

    width: int
    height: int
    depth: int = 8
    mono: bool = False
    quantiser: int = 100
    speed: int = DEFAULT_SPEED
    key_interval: int = 0  # frames from one key frame to the next; 0 for the first one only
    alt_ref: int = 0  # frames of a group that the last one is coded before
    bitrate: int = 0  # bits a second; 0 for a fixed quantiser
    rate: int = 30
    scale: int = 1
    tile_columns: int = 1
    tile_rows: int = 1

    def __post_init__(self):
        if not (0 < self.width <= 65536 and 0 < self.height <= 65536 and self.depth in (8, 10) and 0 < self.quantiser <= 255):
            raise ValueError("sides from 1 to 65536, depths of 8 or 10 bits and quantisers from 1 to 255 are needed")

    def column(self) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in asdict(self).items()])


SETTINGS = [f.name for f in fields(Settings)]
