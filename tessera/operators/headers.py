"""Header arithmetic: reference selection by order hints, sizes, tiles, quantiser indices, checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions import fx

#: Places of the seven references, and the order in which the last ones are filled.
LAST, LAST2, LAST3, GOLDEN, BWDREF, ALTREF2, ALTREF = range(7)
FILLED_LAST = (LAST2, LAST3, BWDREF, ALTREF2, ALTREF)


def frame_refs(hints: Column, last: Column, golden: Column) -> Column:
    """Slots of the seven references from the slots' signed distances to the frame (array of 8).

    ALTREF is the latest backward slot that is free, BWDREF and ALTREF2 the earliest ones, the rest the latest
    forward ones; on ties the latest take the last slot, the earliest the first. What is left takes the earliest.
    """
    slots = F.transform(hints, lambda h, k: F.struct(h.alias("h"), k.cast("int").alias("k")))
    empty = F.array(*[F.when(F.lit(i) == LAST, last).when(F.lit(i) == GOLDEN, golden).cast("int") for i in range(7)])
    state = F.struct(empty.alias("refs"), F.array(last.cast("int"), golden.cast("int")).alias("used"))
    rules = [(ALTREF, "back", "max"), (BWDREF, "back", "min"), (ALTREF2, "back", "min"), *[(r, "fore", "max") for r in FILLED_LAST]]
    steps = F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(side == "back").alias("back"), F.lit(pick == "max").alias("latest")) for r, side, pick in rules])

    def step(s: Column, rule: Column) -> Column:
        free = F.filter(slots, lambda x: ~F.array_contains(s["used"], x["k"]) & ((x["h"] >= 0) == rule["back"]))
        early = F.array_min(free)["k"]
        late = F.array_max(free)["k"]
        found = F.when(rule["latest"], late).otherwise(early)
        take = F.get(s["refs"], rule["ref"]).isNull() & found.isNotNull()
        refs = F.transform(s["refs"], lambda r, i: F.when(take & (i == rule["ref"]), found).otherwise(r))
        return F.struct(refs.alias("refs"), F.when(take, F.concat(s["used"], F.array(found))).otherwise(s["used"]).alias("used"))

    earliest = F.array_min(slots)["k"]
    return F.transform(F.aggregate(steps, state, step)["refs"], lambda r: F.coalesce(r, earliest))


def skip_mode_frames(distances: Column) -> Column:
    """struct(a, b): places of the nearest forward and backward references, or of the two nearest forward ones
    with different hints; null without. distances: signed, of the references in order; zero is neither."""
    places = F.transform(distances, lambda d, k: F.struct(d.alias("d"), (-k).alias("k")))
    fore, back = F.filter(places, lambda p: p["d"] < 0), F.filter(places, lambda p: p["d"] > 0)
    forward = F.array_max(fore)
    backward = F.array_min(F.transform(back, lambda p: F.struct(p["d"].alias("d"), (-p["k"]).alias("k"))))["k"]
    second = F.array_max(F.filter(fore, lambda p: p["d"] < forward["d"]))
    other = F.coalesce(backward, -second["k"])
    first = -forward["k"]
    return F.when(first.isNotNull() & other.isNotNull(), F.struct(F.least(first, other).alias("a"), F.greatest(first, other).alias("b")))


def tile_log2(block: Column, target: Column) -> Column:
    """Least k with block << k >= target."""
    ks = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: fx.shl(block.cast("long"), k) >= target)
    return F.array_min(ks)


def uniform_starts(blocks: Column, log2: Column, shift: int) -> Column:
    """Starts of uniformly spaced tiles over ``blocks`` superblocks, in 4x4 units of 2^shift a superblock."""
    width = fx.shr(blocks + fx.shl(F.lit(1).cast("long"), log2) - 1, log2)
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1, width), lambda s: fx.shl(s, shift))


def superres(width: Column, denominator: Column) -> Column:
    """Coded width of an upscaled one: 8 / denominator (9 to 16), rounded."""
    return fx.idiv(width * 8 + fx.shr(denominator, 1), denominator)


def mi_units(size: Column) -> Column:
    """4x4 units of a side, in whole 8x8 ones."""
    return 2 * fx.shr(size + 7, 3)


def q_index(base: Column, delta: Column) -> Column:
    """Quantiser index of a segment; the base where it has no delta."""
    return F.when(delta.isNull(), base).otherwise(fx.clip3(F.lit(0).cast("long"), F.lit(255).cast("long"), base + delta))


def increasing(values: Column) -> Column:
    """Whether each value of an array is greater than the one before."""
    n = F.size(values)
    ahead = F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.forall(F.zip_with(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), ahead, lambda a, b: b > a), lambda x: x)


def color_error(primaries: Column, transfer: Column, matrix: Column, position: Column) -> Column:
    """Why a colour description cannot be written with 4:2:0 samples; null if it can."""
    wide = (primaries > 255) | (transfer > 255) | (matrix > 255)
    return F.when(wide, "code points").when(position > 3, "sample position").when(matrix == 0, "identity matrix")
