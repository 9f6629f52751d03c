"""Inverse transforms in fixed point and levels as symbols (G3, G7, G8, G10, G11, N8), over residuals of blocks in place of coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import adapters as A, fx
from tessera.operators import blocks as B, coefficients, transforms as T
from tessera.plans.blocks import LEVELS, _levels
from tessera.plans.registry import query

SCALE = 8


def _residuals(spark: SparkSession, folder: str, scale: int = SCALE) -> DataFrame:
    return A.pairs(spark, folder).select("blk", F.transform(B.difference(F.col("v"), F.col("ref")), lambda x: (x * scale).cast("long")).alias("d"))


def _columns(n: int, key: str, value: str) -> str:
    return ", ".join(f"CAST(max(CASE WHEN {key} = {k} THEN {value} END) AS BIGINT) AS t{k}" for k in range(n))


def _digest(n: int, source: str, value: str = "t{k}", place: str = "g * {n} + {k} + 1") -> str:
    """SQL of a block's sums over rows of n columns."""
    values = [value.format(k=k) for k in range(n)]
    weighted = " + ".join(f"({v}) * ({place.format(n=n, k=k)})" for k, v in enumerate(values))
    return f"SELECT blk, CAST(sum({' + '.join(f'({v})' for v in values)}) AS BIGINT) AS total, CAST(sum({weighted}) AS BIGINT) AS weighted FROM {source} GROUP BY blk"


def _line(kind: str, n: int) -> None:
    program = T.KINDS[kind](n)
    text, last = T.spelled(program, n, "x", "blk, g", "st")

    @query(f"{'g7' if kind == 'dct' else 'g8'}_inverse_{kind}{n}", f"WITH {A.PAIRS}, x AS (SELECT blk, p // {n} AS g, {_columns(n, f'p % {n}', f'(s - r) * {SCALE}')} FROM pairs GROUP BY blk, g), {text} {_digest(n, last)}")
    def line(spark: SparkSession, folder: str) -> DataFrame:
        """The transform of every run of n samples of a block."""
        return T.digests(_residuals(spark, folder), lambda d: T.run(program, d.reshape(-1, n)))


for _n in (4, 8, 16, 32, 64):
    _line("dct", _n)
for _n in (4, 8, 16):
    _line("adst", _n)


def _walsh_sql(source: str, name: str, keys: str) -> str:
    return f"{name}a AS (SELECT {keys}, t0 + t1 AS a, t2 - t3 AS d, t1, t3, ((t0 + t1) - (t2 - t3)) >> 1 AS e FROM {source}), {name} AS (SELECT {keys}, a - (e - t3) AS t0, e - t3 AS t1, e - t1 AS t2, d + (e - t1) AS t3 FROM {name}a)"


def _turned(n: int, to: int, source: str) -> str:
    """SQL of columns made of rows: n columns t0, ... of rows i become rows c of ``to`` columns."""
    return f"SELECT blk, g, c, {_columns(to, 'i', 'l[c + 1]')} FROM (SELECT blk, g, i, [{', '.join(f't{k}' for k in range(n))}] AS l FROM {source}), (SELECT unnest(range({n})) AS c) GROUP BY blk, g, c"


_QUARTERS = f"x AS (SELECT blk, g, i, {_columns(4, 'place', 'd >> 2')} FROM (SELECT blk, i // 4 * 2 + j // 4 AS g, i % 4 AS i, j % 4 AS place, s - r AS d FROM pairs) GROUP BY blk, g, i)"


@query("g10_walsh", f"WITH {A.PAIRS}, {_QUARTERS}, {_walsh_sql('x', 'w', 'blk, g, i')}, y AS ({_turned(4, 4, 'w')}), {_walsh_sql('y', 'z', 'blk, g, c')} {_digest(4, 'z', place='g * 16 + {k} * 4 + c + 1')}")
def walsh(spark: SparkSession, folder: str) -> DataFrame:
    """The lossless transform of each quarter of a block: rows, then columns."""

    def both(d):
        rows = T.walsh(T.cells(d, 4, 4).reshape(-1, 4), 2).reshape(-1, 4, 4)
        return T.walsh(rows.swapaxes(1, 2).reshape(-1, 4), 0).reshape(-1, 4, 4).swapaxes(1, 2)

    return T.digests(_residuals(spark, folder, 1), both)


def _block(name: str, width: int, height: int, row: str, column: str, row_shift: int) -> None:
    rows, columns = T.KINDS[row](width), T.KINDS[column](height)
    clamp = lambda x: f"greatest(-32768, least(32767, {x}))"
    rect = (lambda x: f"(({x}) * {T.ROOT_HALF} + 2048) >> 12") if 2 * min(width, height) == max(width, height) else (lambda x: x)
    first, last_row = T.spelled(rows, width, "x", "blk, g, i", "ra")
    between = f"m AS (SELECT blk, g, i, {', '.join(clamp(f'(t{k} + {1 << row_shift >> 1}) >> {row_shift}') + f' AS t{k}' for k in range(width))} FROM {last_row})"
    second, last = T.spelled(columns, height, "y", "blk, g, c", "ca")
    cell = f"i // {height} * {8 // width} + j // {width}"
    source = f"x AS (SELECT blk, g, i, {_columns(width, 'place', rect(clamp(f'd * {SCALE}')))} FROM (SELECT blk, {cell} AS g, i % {height} AS i, j % {width} AS place, s - r AS d FROM pairs) GROUP BY blk, g, i)"

    @query(name, f"WITH {A.PAIRS}, {source}, {first}, {between}, y AS ({_turned(width, height, 'm')}), {second} {_digest(height, last, value='(t{k} + 8) >> 4', place=f'g * {width * height} + {{k}} * {width} + c + 1')}")
    def block(spark: SparkSession, folder: str) -> DataFrame:
        """Both passes over each part of a block of the size."""
        return T.digests(_residuals(spark, folder), lambda d: T.inverse_2d(T.cells(d, height, width), rows, columns, row_shift))


_block("g11_inverse_2d", 8, 8, "dct", "dct", 1)
_block("g11_inverse_2d_sine", 8, 8, "adst", "dct", 1)
_block("g11_inverse_2d_4x4", 4, 4, "adst", "dct", 0)
_block("g11_inverse_2d_8x4", 8, 4, "dct", "adst", 0)
_block("g11_inverse_2d_4x8", 4, 8, "adst", "adst", 0)


@query("n8_cosines", "SELECT CAST(range AS INTEGER) AS angle, CAST(round(4096 * cos(pi() * range / 128)) AS INTEGER) AS cosine, CAST(round(4096 * sin(pi() * range / 128)) AS INTEGER) AS sine FROM range(257)")
def cosines(spark: SparkSession, folder: str) -> DataFrame:
    """The table of cosines and sines in 12 bits."""
    table = lambda f: F.array(*[F.lit(f(k)) for k in range(257)])
    return spark.range(257).select(F.col("id").cast("int").alias("angle"), F.get(table(T.cos128), F.col("id").cast("int")).alias("cosine"), F.get(table(T.sin128), F.col("id").cast("int")).alias("sine"))


@query("g3_coefficients", f"{LEVELS} SELECT blk, CAST(sum(abs(l)) AS BIGINT) AS size, CAST(sum(l * (p + 1)) AS BIGINT) AS checksum, CAST(max(abs(l)) AS BIGINT) AS largest, CAST(sum(CASE WHEN l < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM lev GROUP BY blk")
def coded_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Quantised levels coded as symbols, a stream a frame, and read back."""
    own = _levels(spark, folder).select("blk", fx.idiv(F.col("blk"), A.FRAME_BLOCKS).alias("frame"), "l")
    back = coefficients.coded(own)
    return back.select("blk", B.total(F.transform("levels", lambda x: F.abs(x))).alias("size"), B.total(F.transform("levels", lambda x, p: x * (p + 1))).alias("checksum"), F.array_max(F.transform("levels", lambda x: F.abs(x))).alias("largest"), B.total(F.transform("levels", lambda x: F.when(x < 0, 1).otherwise(0))).alias("negative"))
