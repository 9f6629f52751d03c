"""Headers read from and written to bits (A21, B1, B2, B5, B9, B11, B12, B15, D1), from digests of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import adapters as A
from tessera.plans.registry import query
from tessera.plans.scalars import WITH, _hex
from tessera.sources import syntax as X
from tessera.sources.containers import Malformed, Unsupported


def _long(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, data: 512 bytes that follow from the whole text: its digest again and again, each time turned by a place."""
    own = A.digests(spark, folder)
    turned = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.concat(F.substring("hex", k + 1, F.lit(32)), F.substring(F.col("hex"), F.lit(1), k)))
    return own.select("doc_id", F.unhex(F.array_join(turned, "")).alias("data"))


def _each(frame: DataFrame, function, schema: str) -> DataFrame:
    """A function of data to a tuple, with what is wrong instead where it is: rows doc_id, its fields, error."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("data").to_pylist():
                try:
                    rows.append((*function(data), None))
                except Unsupported:
                    rows.append((*[None] * len(names), "Unsupported"))
                except Malformed:
                    rows.append((*[None] * len(names), "Bitstream"))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, [*types, pa.string()], strict=True)]], ["doc_id", *names, "error"])

    return frame.select("doc_id", "data").mapInArrow(run, f"doc_id long, {schema}, error string")


@query("b1_seq_header", f"{WITH}, f AS (SELECT doc_id, {_hex(0, 3)} AS p, {_hex(3, 1)} AS still, {_hex(4, 1)} AS reduced FROM digests) SELECT doc_id, CASE WHEN p <= 2 THEN p END AS profile, CASE WHEN p <= 2 THEN still END AS still, CASE WHEN p <= 2 THEN reduced END AS reduced, CASE WHEN p > 2 THEN 'Unsupported' END AS error FROM f")
def seq_header(spark: SparkSession, folder: str) -> DataFrame:
    """First fields of sequence headers; profiles above 2 are not supported."""

    def fields(data: bytes) -> tuple:
        s = X.read(X.sequence_header, data)
        return s["profile"], s["still"], s["reduced"]

    return _each(_long(spark, folder), fields, "profile long, still long, reduced long")


def _supported(data: bytes) -> X.Record:
    """A sequence header with the data's bits, its profile made one that is supported."""
    return X.read(X.sequence_header, bytes([data[0] % 3 << 5 | data[0] & 31]) + data[1:])


@query("b2_seq_header_write", f"{WITH} SELECT doc_id, true AS same, CAST(NULL AS VARCHAR) AS error FROM digests")
def seq_header_write(spark: SparkSession, folder: str) -> DataFrame:
    """Headers written and read again."""

    def same(data: bytes) -> tuple:
        s = _supported(data)
        return (X.read(X.sequence_header, X.write(X.sequence_header, s)) == s,)

    return _each(_long(spark, folder), same, "same boolean")


def _frames(data: bytes) -> Iterator[tuple[X.Record, X.Record, list]]:
    """Frame headers with bits of the data: a key frame for all slots, then frames that refer to them."""
    s = _supported(data)
    s.update(reduced=0, still=0, width_bits=9, height_bits=9, max_width=639, max_height=479)
    slots: list = [None] * X.SLOTS
    for k in range(4):
        start = b"\x10" if k == 0 else bytes([0x30 | data[k] & 15])  # a shown key frame, then shown inter frames
        h = X.read(X.frame_header, start + data[16 * k + 1 :] + data, s, slots)
        yield s, h, list(slots)
        if not h["show_existing"]:
            slots = [h if h["refresh"] >> i & 1 else old for i, old in enumerate(slots)]


@query("b5_frame_header")
def frame_header(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the first frame headers that a digest's bits give, or what is wrong with them."""

    def fields(data: bytes) -> tuple:
        _, h, _ = next(_frames(data))
        return h["mi_cols"], h["mi_rows"], len(h["tiles"]["col_starts"]) * len(h["tiles"]["row_starts"]), h["quant"]["base"], h["lossless"]

    return _each(_long(spark, folder), fields, "mi_cols long, mi_rows long, tiles long, base_q long, lossless long")


@query("b15_frame_header_write")
def frame_header_write(spark: SparkSession, folder: str) -> DataFrame:
    """Frame headers written and read again, against the same slots."""

    def same(data: bytes) -> tuple:
        n = 0
        for s, h, slots in _frames(data):
            if X.read(X.frame_header, X.write(X.frame_header, h, s, slots), s, slots) != h:
                return n, False
            n += 1
        return n, True

    return _each(_long(spark, folder), same, "frames long, same boolean")


def _part(name: str, describe, *context, whole: bool = True) -> None:
    """Registers a query that reads one part of a header, writes it and reads it again. whole: any bits are a part."""

    claim = f"{WITH} SELECT doc_id, true AS same, CAST(NULL AS VARCHAR) AS error FROM digests"

    @query(name, claim if whole else None)
    def part(spark: SparkSession, folder: str) -> DataFrame:
        def same(data: bytes) -> tuple:
            first = {k: list(v) if isinstance(v, list) else v for k, v in context[0].items()}
            describe(X.Bits(data), first, *context[1:])
            out = X.Bits()
            describe(out, first, *context[1:])
            again = {k: list(v) if isinstance(v, list) else v for k, v in context[0].items()}
            describe(X.Bits(out.data()), again, *context[1:])
            return (first == again,)

        return _each(_long(spark, folder), same, "same boolean")


#: The digest's bits as text.
_BITS = "b AS (SELECT doc_id, list_reduce(list_transform(range(1, 33), lambda k: lpad(bin(CAST('0x' || substr(hex, CAST(k AS BIGINT), 1) AS BIGINT)), 4, '0')), lambda x, y: x || y) AS bits FROM digests)"


def _f(at: str, n: int) -> str:
    """SQL of the n bits at a place that is an expression."""
    return "(" + " + ".join(f"(CAST(substr(bits, CAST(({at}) + {k + 1} AS BIGINT), 1) AS BIGINT) << {n - 1 - k})" for k in range(n)) + ")"


def _walked(steps: list[tuple[str, str, int, str]], outputs: str) -> str:
    """SQL of fields read one after the other: (name, condition, bits, kind); a field whose condition fails is null and takes no bits."""
    parts, source = [], "(SELECT *, 0 AS pos FROM b)"
    for k, (name, when, n, kind) in enumerate(steps):
        value = _f("pos", n)
        value = f"{value} - CASE WHEN {value} >= {1 << n - 1} THEN {1 << n} ELSE 0 END" if kind == "su" else value
        parts.append(f"w{k} AS MATERIALIZED (SELECT *, CASE WHEN {when} THEN {value} END AS {name}, pos + CASE WHEN {when} THEN {n} ELSE 0 END AS pos_ FROM {source})")
        parts.append(f"v{k} AS (SELECT * EXCLUDE (pos, pos_), pos_ AS pos FROM w{k})")
        source = f"v{k}"
    return f"{WITH}, {_BITS}, {', '.join(parts)} SELECT doc_id, {outputs}, CAST(NULL AS VARCHAR) AS error FROM {source}"


def _fields_of(name: str, describe, context: tuple, pick, schema: str, steps: list[tuple[str, str, int, str]], outputs: str) -> None:
    """Registers a query that reads a part of a header, against SQL that reads the same bits."""

    @query(name, _walked(steps, outputs))
    def fields(spark: SparkSession, folder: str) -> DataFrame:
        def read(data: bytes) -> tuple:
            h = {k: list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) else v for k, v in context[0].items()}
            describe(X.Bits(data), h, *context[1:])
            return pick(h)

        return _each(_long(spark, folder), read, schema)


def _delta_steps(name: str, when: str = "true") -> list[tuple[str, str, int, str]]:
    return [(f"{name}_on", when, 1, "f"), (name, f"coalesce({name}_on, 0) = 1", 7, "su")]


_SEQUENCE = {"color": {"mono": 0, "ssx": 1, "ssy": 1, "separate_uv_delta_q": 1, "depth": 8}, "sb128": 0, "film_grain": 1, "cdef": 1, "restoration": 1}
_part("b9_quantisation", X.quantisation, {}, _SEQUENCE)
_part("b9_segmentation", X.segmentation, {"primary": X.PRIMARY_NONE}, None)
_part("b9_loop_filter", X.loop_filter, {"lossless": 0, "intrabc": 0}, _SEQUENCE, None)
_part("b9_deltas", X.deltas, {"quant": {"base": 1}, "intrabc": 0})
_part("b9_cdef", X.cdef, {"lossless": 0, "intrabc": 0}, _SEQUENCE)
_part("b9_restoration", X.restoration, {"all_lossless": 0, "intrabc": 0}, _SEQUENCE)
_part("b11_global_motion", X.global_motion, {"intra": 0, "high_precision": 1}, None)
_part("b12_film_grain", X.film_grain, {"show": 1, "showable": 0, "type": X.KEY}, _SEQUENCE, whole=False)


_fields_of(
    "b9_quantisation_fields", X.quantisation, ({}, _SEQUENCE), lambda h: tuple(h["quant"].get(k) for k in ("base", "y_dc", "u_dc", "u_ac", "v_dc", "v_ac", "matrix", "level_y", "level_u", "level_v")), "base long, y_dc long, u_dc long, u_ac long, v_dc long, v_ac long, matrix long, level_y long, level_u long, level_v long",
    [("base", "true", 8, "f"), *_delta_steps("y_dc"), ("diff", "true", 1, "f"), *_delta_steps("u_dc"), *_delta_steps("u_ac"), *_delta_steps("v_dc", "diff = 1"), *_delta_steps("v_ac", "diff = 1"), ("matrix", "true", 1, "f"), ("level_y", "matrix = 1", 4, "f"), ("level_u", "matrix = 1", 4, "f"), ("level_v", "matrix = 1", 4, "f")],
    "base, coalesce(y_dc, 0) AS y_dc, coalesce(u_dc, 0) AS u_dc, coalesce(u_ac, 0) AS u_ac, CASE WHEN diff = 1 THEN coalesce(v_dc, 0) ELSE coalesce(u_dc, 0) END AS v_dc, CASE WHEN diff = 1 THEN coalesce(v_ac, 0) ELSE coalesce(u_ac, 0) END AS v_ac, matrix, level_y, level_u, level_v",
)
_fields_of(
    "b9_delta_fields", X.deltas, ({"quant": {"base": 1}, "intrabc": 0},), lambda h: tuple(h["deltas"].get(k) for k in ("q", "q_res", "lf", "lf_res", "lf_multi")), "q long, q_res long, lf long, lf_res long, lf_multi long",
    [("q", "true", 1, "f"), ("q_res", "q = 1", 2, "f"), ("lf", "q = 1", 1, "f"), ("lf_res", "coalesce(lf, 0) = 1", 2, "f"), ("lf_multi", "coalesce(lf, 0) = 1", 1, "f")], "q, q_res, lf, lf_res, lf_multi",
)
_fields_of(
    "b9_cdef_fields", X.cdef, ({"lossless": 0, "intrabc": 0}, _SEQUENCE), lambda h: (h["cdef"]["damping_less_3"], h["cdef"]["bits"], *(sum(p[k] for p in h["cdef"]["strengths"]) for k in ("y_primary", "y_secondary", "uv_primary", "uv_secondary"))), "damping_less_3 long, bits long, y_primary long, y_secondary long, uv_primary long, uv_secondary long",
    [("damping_less_3", "true", 2, "f"), ("number", "true", 2, "f"), *[(f"{name}{k}", f"{k} < (1 << CAST(number AS INTEGER))", n, "f") for k in range(8) for name, n in (("yp", 4), ("ys", 2), ("up", 4), ("us", 2))]],
    "damping_less_3, number AS bits, " + ", ".join(f"{' + '.join(f'coalesce({name}{k}, 0)' for k in range(8))} AS {to}" for name, to in (("yp", "y_primary"), ("ys", "y_secondary"), ("up", "uv_primary"), ("us", "uv_secondary"))),
)
_fields_of(
    "b9_restoration_fields", X.restoration, ({"all_lossless": 0, "intrabc": 0}, _SEQUENCE), lambda h: (*(p["type"] for p in h["restoration"]["planes"]), *(h["restoration"].get(k) for k in ("shift", "more_shift", "uv_shift"))), "y long, u long, v long, shift long, more_shift long, uv_shift long",
    [("y", "true", 2, "f"), ("u", "true", 2, "f"), ("v", "true", 2, "f"), ("shift", "y + u + v > 0", 1, "f"), ("more_shift", "coalesce(shift, 0) = 1", 1, "f"), ("uv_shift", "u + v > 0", 1, "f")], "y, u, v, shift, more_shift, uv_shift",
)
_fields_of(
    "b9_loop_filter_fields", X.loop_filter, ({"lossless": 0, "intrabc": 0}, _SEQUENCE, None), lambda h: (*h["loop_filter"]["levels"], h["loop_filter"]["sharpness"], h["loop_filter"]["delta_enabled"], *h["loop_filter"]["ref_deltas"], *h["loop_filter"]["mode_deltas"]), "v long, h long, u long, w long, sharpness long, delta_enabled long, " + ", ".join(f"ref{k} long" for k in range(8)) + ", mode0 long, mode1 long",
    [("v", "true", 6, "f"), ("h", "true", 6, "f"), ("u", "v > 0 OR h > 0", 6, "f"), ("w", "v > 0 OR h > 0", 6, "f"), ("sharpness", "true", 3, "f"), ("delta_enabled", "true", 1, "f"), ("delta_update", "delta_enabled = 1", 1, "f"), *[step for name in [f"ref{k}" for k in range(8)] + ["mode0", "mode1"] for step in _delta_steps(name, "coalesce(delta_update, 0) = 1")]],
    "v, h, coalesce(u, 0) AS u, coalesce(w, 0) AS w, sharpness, delta_enabled, " + ", ".join(f"coalesce({name}, {base}) AS {name}" for name, base in zip([f"ref{k}" for k in range(8)] + ["mode0", "mode1"], [*X.LF_REF, *X.LF_MODE], strict=True)),
)


@query("a21_subexp", f"{WITH}, f AS (SELECT doc_id, {_hex(0, 9)} AS r, {_hex(9, 9)} AS v FROM digests) SELECT doc_id, r - 256 AS ref, v - 256 AS value, CAST(NULL AS VARCHAR) AS error FROM f")
def subexp(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers coded relative to a reference, and back."""

    def back(data: bytes) -> tuple:
        head = int.from_bytes(data[:4], "big")
        ref, value = (head >> 23) - 256, (head >> 14 & 511) - 256
        out = X.Bits()
        out.subexp({"v": value}, "v", -256, 256, ref)
        found: X.Record = {}
        X.Bits(out.data()).subexp(found, "v", -256, 256, ref)
        return ref, found["v"]

    return _each(_long(spark, folder), back, "ref long, value long")


@query("d1_tile_group", f"{WITH} SELECT doc_id, 1 + {_hex(0, 3)} AS tiles, 512 AS bytes, true AS same, CAST(NULL AS VARCHAR) AS error FROM digests")
def tile_group(spark: SparkSession, folder: str) -> DataFrame:
    """Data dealt to tiles, packed with their sizes and split again."""

    def same(data: bytes) -> tuple:
        n = 1 + (data[0] >> 5)
        step = len(data) // n
        tiles = [data[k * step : (k + 1) * step if k < n - 1 else None] for k in range(n)]
        found = X.tile_sizes(X.tile_group(tiles, 2), n, 2)
        return n, sum(map(len, found)), found == tiles

    return _each(_long(spark, folder), same, "tiles long, bytes long, same boolean")
