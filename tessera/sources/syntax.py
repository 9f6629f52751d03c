"""Stream headers, each described once for reading and writing.

A description is a function of a ``Bits`` object and a record (a dict). ``b.f(record, name, n)`` reads n bits
into the record, or writes them from it; conditions refer to fields that were passed before, so that one text
serves as parser, writer and documentation of a header. Derived values are set in both directions.
"""

from __future__ import annotations

from typing import Any

from tessera.sources.containers import Malformed, Unsupported

Record = dict[str, Any]


class Bits:
    """Bits of ``data``, to be read, or without data, to be written."""

    def __init__(self, data: bytes | None = None):
        self.reading = data is not None
        self.value, self.size = (int.from_bytes(data, "big"), 8 * len(data)) if data is not None else (0, 0)
        self.at = 0

    def bits(self, value: int, n: int) -> int:
        if self.reading:
            if self.at + n > self.size:
                raise Malformed("header runs past the end")
            value = self.value >> self.size - self.at - n & (1 << n) - 1
        elif not 0 <= value < 1 << n:
            raise ValueError(f"{value} does not fit in {n} bits")
        else:
            self.value, self.size = self.value << n | value, self.size + n
        self.at += n
        return value

    def data(self) -> bytes:
        """What was written, closed by a one bit and zeros."""
        n = self.size + 1
        return ((self.value << 1 | 1) << -n % 8).to_bytes((n + 7) // 8, "big")

    def _pass(self, r: Record, name: str, code) -> Any:
        r[name] = code(0 if self.reading else int(r.get(name, 0)))
        return r[name]

    def f(self, r: Record, name: str, n: int) -> int:
        return self._pass(r, name, lambda v: self.bits(v, n))

    def flag(self, r: Record, name: str) -> int:
        return self.f(r, name, 1)

    def su(self, r: Record, name: str, n: int) -> int:
        def code(v: int) -> int:
            u = self.bits(v & (1 << n) - 1, n)
            return u - (u >> n - 1 << n)

        return self._pass(r, name, code)

    def ns(self, r: Record, name: str, n: int) -> int:
        """A number below n."""
        w = n.bit_length()
        m = (1 << w) - n

        def code(v: int) -> int:
            if n <= 1:
                return 0
            short = self.bits(v if v < m else v + m >> 1, w - 1)
            return short if short < m else 2 * short - m + self.bits(v + m & 1, 1)

        return self._pass(r, name, code)

    def uvlc(self, r: Record, name: str) -> int:
        def code(v: int) -> int:
            zeros = (v + 1).bit_length() - 1
            if self.reading:
                zeros = 0
                while not self.bits(0, 1):
                    zeros += 1
                    if zeros > 40:
                        raise Malformed("code of more than 40 zeros")
                if zeros >= 32:
                    return (1 << 32) - 1
            else:
                self.bits(1, zeros + 1)
            return self.bits(v + 1 - (1 << zeros), zeros) + (1 << zeros) - 1

        return self._pass(r, name, code)

    def subexp(self, r: Record, name: str, low: int, high: int, ref: int) -> int:
        """A number from low to high - 1, short near ``ref``."""

        def folded(v: int, c: int) -> int:  # distance to c, alternating sides
            return v if v > 2 * c else 2 * (v - c) if v >= c else 2 * (c - v) - 1

        def unfolded(d: int, c: int) -> int:
            return d if d > 2 * c else c - (d + 1 >> 1) if d & 1 else c + (d >> 1)

        def near(n: int, v: int) -> int:
            base, width, first = 0, 3, True
            while True:
                step = 1 << width
                if n <= base + 3 * step:
                    part = {"v": v - base}
                    return base + self.ns(part, "v", n - base)
                if not self.bits(int(v >= base + step), 1):
                    return base + self.bits(v - base, width)
                base, width, first = base + step, width + (not first), False

        n, c = high - low, ref - low

        def code(v: int) -> int:
            v -= low
            if 2 * c <= n:
                return unfolded(near(n, folded(v, c)), c) + low
            return n - 1 - unfolded(near(n, folded(n - 1 - v, n - 1 - c)), n - 1 - c) + low

        return self._pass(r, name, code)

    def each(self, r: Record, name: str, n: int) -> list[Record]:
        """n records below a name."""
        if self.reading or name not in r:
            r[name] = [{} for _ in range(n)]
        return r[name]

    def part(self, r: Record, name: str) -> Record:
        if self.reading or name not in r:
            r[name] = {}
        return r[name]


#: Fixed values of the format.
UNSPECIFIED, BT709, SRGB, IDENTITY = 2, 1, 13, 0
SELECT = 2
KEY, INTER, INTRA_ONLY, SWITCH = range(4)
FEATURES = ((8, 1, 255), (6, 1, 63), (6, 1, 63), (6, 1, 63), (6, 1, 63), (3, 0, 7), (0, 0, 0), (0, 0, 0))  # bits, sign, bound of segment features
SLOTS, REFS = 8, 7
PRIMARY_NONE = 7


def color_config(b: Bits, s: Record) -> None:
    c, profile = b.part(s, "color"), s["profile"]
    b.flag(c, "high_bitdepth")
    if profile == 2 and c["high_bitdepth"]:
        b.flag(c, "twelve_bit")
    c["depth"] = 12 if c.get("twelve_bit") else 10 if c["high_bitdepth"] else 8
    c["mono"] = 0 if profile == 1 else b.flag(c, "mono")
    if b.flag(c, "described"):
        for name in ("primaries", "transfer", "matrix"):
            b.f(c, name, 8)
    else:
        c.update(primaries=UNSPECIFIED, transfer=UNSPECIFIED, matrix=UNSPECIFIED)
    c["ssx"] = c["ssy"] = 1
    if c["mono"]:
        b.flag(c, "full_range")
        return
    if (c["primaries"], c["transfer"], c["matrix"]) == (BT709, SRGB, IDENTITY):
        c.update(full_range=1, ssx=0, ssy=0)
    else:
        b.flag(c, "full_range")
        if profile == 2 and c["depth"] == 12:
            if b.flag(c, "half_x"):
                b.flag(c, "half_y")
            c["ssx"], c["ssy"] = c["half_x"], c.get("half_y", 0) if c["half_x"] else 0
        else:
            c["ssx"], c["ssy"] = int(profile != 1), int(profile == 0)
        if c["ssx"] and c["ssy"]:
            b.f(c, "position", 2)
    b.flag(c, "separate_uv_delta_q")


def sequence_header(b: Bits, s: Record) -> None:
    if b.f(s, "profile", 3) > 2:
        raise Unsupported(f"profile {s['profile']}")
    b.flag(s, "still")
    s.setdefault("decoder_model", 0)
    if b.flag(s, "reduced"):
        points = b.each(s, "points", 1)
        b.f(points[0], "level", 5)
        points[0]["idc"] = 0
    else:
        if b.flag(s, "timing"):
            b.f(s, "display_tick", 32)
            b.f(s, "time_scale", 32)
            if b.flag(s, "equal_interval"):
                b.uvlc(s, "ticks_per_picture")
            if b.flag(s, "decoder_model"):
                b.f(s, "delay_bits", 5)
                b.f(s, "decoding_tick", 32)
                b.f(s, "removal_bits", 5)
                b.f(s, "presentation_bits", 5)
        b.flag(s, "display_delay")
        b.f(s, "more_points", 5)
        for p in b.each(s, "points", s["more_points"] + 1):
            b.f(p, "idc", 12)
            if b.f(p, "level", 5) > 7:
                b.flag(p, "tier")
            if s["decoder_model"] and b.flag(p, "modelled"):
                b.f(p, "decoder_delay", s["delay_bits"] + 1)
                b.f(p, "encoder_delay", s["delay_bits"] + 1)
                b.flag(p, "low_delay")
            if s["display_delay"] and b.flag(p, "delayed"):
                b.f(p, "delay", 4)
    b.f(s, "width_bits", 4)
    b.f(s, "height_bits", 4)
    b.f(s, "max_width", s["width_bits"] + 1)
    b.f(s, "max_height", s["height_bits"] + 1)
    if not s["reduced"] and b.flag(s, "frame_ids"):
        b.f(s, "delta_id_bits", 4)
        b.f(s, "id_bits", 3)
    for name in ("sb128", "filter_intra", "edge_filter"):
        b.flag(s, name)
    s.update(screen_content=SELECT, integer_mv=SELECT, hint_bits=0) if b.reading or s["reduced"] else None
    if not s["reduced"]:
        for name in ("interintra", "masked", "warped", "dual_filter", "order_hint"):
            b.flag(s, name)
        if s["order_hint"]:
            b.flag(s, "jnt_comp")
            b.flag(s, "ref_mvs")
        if not b.flag(s, "choose_screen"):
            b.flag(s, "screen_content")
        else:
            s["screen_content"] = SELECT
        if s["screen_content"]:
            if not b.flag(s, "choose_integer"):
                b.flag(s, "integer_mv")
            else:
                s["integer_mv"] = SELECT
        else:
            s["integer_mv"] = SELECT
        if s["order_hint"]:
            b.f(s, "hint_bits_less_1", 3)
            s["hint_bits"] = s["hint_bits_less_1"] + 1
        else:
            s["hint_bits"] = 0
    for name in ("superres", "cdef", "restoration"):
        b.flag(s, name)
    color_config(b, s)
    b.flag(s, "film_grain")


def frame_size(b: Bits, h: Record, s: Record) -> None:
    if h["size_override"]:
        b.f(h, "width_less_1", s["width_bits"] + 1)
        b.f(h, "height_less_1", s["height_bits"] + 1)
    else:
        h["width_less_1"], h["height_less_1"] = s["max_width"], s["max_height"]
    superres(b, h, s)


def superres(b: Bits, h: Record, s: Record) -> None:
    denominator = 8
    if s["superres"] and b.flag(h, "use_superres"):
        denominator = b.f(h, "coded_denominator", 3) + 9
    h["upscaled_width"] = h["width_less_1"] + 1
    h["frame_width"] = (h["upscaled_width"] * 8 + denominator // 2) // denominator
    h["frame_height"] = h["height_less_1"] + 1
    h["mi_cols"], h["mi_rows"] = (2 * (n + 7 >> 3) for n in (h["frame_width"], h["frame_height"]))


def render_size(b: Bits, h: Record) -> None:
    if b.flag(h, "render_differs"):
        b.f(h, "render_width", 16)
        b.f(h, "render_height", 16)


def tile_log2(block: int, target: int) -> int:
    k = 0
    while block << k < target:
        k += 1
    return k


def tile_info(b: Bits, h: Record, s: Record) -> None:
    t = b.part(h, "tiles")
    shift = 5 if s["sb128"] else 4
    cols, rows = (h[n] + (1 << shift) - 1 >> shift for n in ("mi_cols", "mi_rows"))
    widest, area = 4096 >> shift + 2, 4096 * 2304 >> 2 * (shift + 2)
    least_cols = tile_log2(widest, cols)
    least = max(least_cols, tile_log2(area, rows * cols))

    def more(name: str, low: int, high: int) -> int:
        """A logarithm in unary, from low to high at most."""
        value = low
        while value < high:
            one = {"v": int(not b.reading and t.get(name, low) > value)}
            if not b.flag(one, "v"):
                break
            value += 1
        t[name] = value
        return value

    if b.flag(t, "uniform"):
        for name, n, low, key in (("cols_log2", cols, least_cols, "col_starts"), ("rows_log2", rows, None, "row_starts")):
            k = more(name, low if low is not None else max(least - t["cols_log2"], 0), tile_log2(1, min(n, 64)))
            step = n + (1 << k) - 1 >> k
            t[key] = list(range(0, n, step))
    else:
        most = widest
        for name, n, key in (("cols_log2", cols, "col_starts"), ("rows_log2", rows, "row_starts")):
            given = [y - x for x, y in zip(t[key], [*t[key][1:], n], strict=True)] if not b.reading and key in t else []
            starts, at = [], 0
            while at < n:
                size = {"v": given[len(starts)] - 1 if given else 0}
                starts.append(at)
                at += b.ns(size, "v", min(n - at, most)) + 1
            t[key], t[name] = starts, tile_log2(1, len(starts))
            if key == "col_starts":
                wide = max(y - x for x, y in zip(starts, [*starts[1:], n], strict=True))
                most = max((rows * cols >> least + 1 if least else rows * cols) // wide, 1)
        if len(t["col_starts"]) > 64 or len(t["row_starts"]) > 64:
            raise Malformed("too many tiles")
    if t["cols_log2"] or t["rows_log2"]:
        b.f(t, "context_tile", t["cols_log2"] + t["rows_log2"])
        b.f(t, "size_bytes_less_1", 2)
        if t["context_tile"] >= len(t["col_starts"]) * len(t["row_starts"]):
            raise Malformed("context tile beyond the tiles")


def _delta(b: Bits, r: Record, name: str) -> int:
    r[name] = b.su(r, name, 7) if b.flag(r, f"has_{name}") else 0
    return r[name]


def quantisation(b: Bits, h: Record, s: Record) -> None:
    q, c = b.part(h, "quant"), s["color"]
    b.f(q, "base", 8)
    _delta(b, q, "y_dc")
    if not c["mono"]:
        q["diff"] = b.flag(q, "diff") if c["separate_uv_delta_q"] else 0
        for name in ("u_dc", "u_ac"):
            _delta(b, q, name)
        if q["diff"]:
            for name in ("v_dc", "v_ac"):
                _delta(b, q, name)
        else:
            q.update(v_dc=q["u_dc"], v_ac=q["u_ac"])
    if b.flag(q, "matrix"):
        b.f(q, "level_y", 4)
        b.f(q, "level_u", 4)
        if not c["mono"] and c["separate_uv_delta_q"]:
            b.f(q, "level_v", 4)
        else:
            q["level_v"] = q["level_u"]


def segmentation(b: Bits, h: Record, previous: Record | None) -> None:
    g = b.part(h, "segments")
    if not b.flag(g, "enabled"):
        g["features"] = [[0] * 8 for _ in range(8)]
        g["on"] = [[0] * 8 for _ in range(8)]
        return
    if h["primary"] == PRIMARY_NONE:
        g.update(update_map=1, temporal=0, update_data=1)
    else:
        if b.flag(g, "update_map"):
            b.flag(g, "temporal")
        b.flag(g, "update_data")
    if not g["update_data"]:
        g["on"], g["features"] = ([list(x) for x in previous[k]] for k in ("on", "features")) if previous else ([[0] * 8 for _ in range(8)] for _ in range(2))
        return
    on, values = g.get("on"), g.get("features")
    new_on, new = [[0] * 8 for _ in range(8)], [[0] * 8 for _ in range(8)]
    for i in range(8):
        for j, (n, signed, bound) in enumerate(FEATURES):
            cell = {"on": 0 if b.reading else on[i][j], "v": 0 if b.reading else values[i][j]}
            if b.flag(cell, "on"):
                if signed:
                    b.su(cell, "v", n + 1)
                else:
                    b.f(cell, "v", n)
                new_on[i][j], new[i][j] = 1, max(-bound if signed else 0, min(bound, cell["v"]))
    g["on"], g["features"] = new_on, new


def deltas(b: Bits, h: Record) -> None:
    d = b.part(h, "deltas")
    d["q"] = b.flag(d, "q") if h["quant"]["base"] else 0
    if d["q"]:
        b.f(d, "q_res", 2)
        if not h["intrabc"] and b.flag(d, "lf"):
            b.f(d, "lf_res", 2)
            b.flag(d, "lf_multi")


LF_REF, LF_MODE = [1, 0, 0, 0, -1, 0, -1, -1], [0, 0]  # fixed values: default deltas


def loop_filter(b: Bits, h: Record, s: Record, previous: Record | None) -> None:
    f = b.part(h, "loop_filter")
    base = previous or {"ref_deltas": LF_REF, "mode_deltas": LF_MODE}
    wanted = {k: f.get(k, base[k]) for k in ("ref_deltas", "mode_deltas")}
    f.update(ref_deltas=list(base["ref_deltas"]), mode_deltas=list(base["mode_deltas"]))
    if h["lossless"] or h["intrabc"]:
        f.update(levels=[0] * 4, ref_deltas=list(LF_REF), mode_deltas=list(LF_MODE))
        return
    levels = list(f.get("levels", [0] * 4)) if not b.reading else [0] * 4
    cells = {"v": levels[0], "w": levels[1], "x": levels[2], "y": levels[3]}
    b.f(cells, "v", 6)
    b.f(cells, "w", 6)
    if not s["color"]["mono"] and (cells["v"] or cells["w"]):
        b.f(cells, "x", 6)
        b.f(cells, "y", 6)
    f["levels"] = [cells[k] for k in "vwxy"]
    b.f(f, "sharpness", 3)
    if b.flag(f, "delta_enabled") and b.flag(f, "delta_update"):
        for key in ("ref_deltas", "mode_deltas"):
            for i in range(len(f[key])):
                cell = {"on": int(wanted[key][i] != f[key][i]), "v": wanted[key][i]}
                if b.flag(cell, "on"):
                    f[key][i] = b.su(cell, "v", 7)


def cdef(b: Bits, h: Record, s: Record) -> None:
    c = b.part(h, "cdef")
    if h["lossless"] or h["intrabc"] or not s["cdef"]:
        return
    b.f(c, "damping_less_3", 2)
    b.f(c, "bits", 2)
    for p in b.each(c, "strengths", 1 << c["bits"]):
        b.f(p, "y_primary", 4)
        b.f(p, "y_secondary", 2)
        if not s["color"]["mono"]:
            b.f(p, "uv_primary", 4)
            b.f(p, "uv_secondary", 2)


def restoration(b: Bits, h: Record, s: Record) -> None:
    l = b.part(h, "restoration")
    if h["all_lossless"] or h["intrabc"] or not s["restoration"]:
        return
    planes = b.each(l, "planes", 1 if s["color"]["mono"] else 3)
    for p in planes:
        b.f(p, "type", 2)
    if not any(p["type"] for p in planes):
        return
    if s["sb128"]:
        b.flag(l, "shift")
    elif b.flag(l, "shift"):
        b.flag(l, "more_shift")
    if s["color"]["ssx"] and s["color"]["ssy"] and any(p["type"] for p in planes[1:]):
        b.flag(l, "uv_shift")


IDENTITY_WARP = [0, 0, 1 << 16, 0, 0, 1 << 16]  # fixed value


def global_motion(b: Bits, h: Record, previous: list[list[int]] | None) -> None:
    wanted = h.get("motion")
    h["motion"] = [{"type": 0, "params": list(IDENTITY_WARP)} for _ in range(REFS)]
    if h["intra"]:
        return
    for k, m in enumerate(h["motion"]):
        base = previous[k] if previous else IDENTITY_WARP
        want = wanted[k] if wanted and not b.reading else {"type": 0, "params": list(IDENTITY_WARP)}
        kinds = {"on": int(want["type"] > 0), "rot": int(want["type"] == 2), "tr": int(want["type"] == 1)}
        if b.flag(kinds, "on"):
            m["type"] = 2 if b.flag(kinds, "rot") else 1 if b.flag(kinds, "tr") else 3

        def param(i: int, m=m, base=base, want=want) -> None:
            bits, precision = (12, 15) if i > 1 else (12, 6)
            if i < 2 and m["type"] == 1:
                bits, precision = 9 - (not h["high_precision"]), 3 - (not h["high_precision"])
            shift = 16 - precision
            one = 1 << precision if i in (2, 5) else 0
            cell = {"v": (want["params"][i] >> shift) - one}
            b.subexp(cell, "v", -(1 << bits), (1 << bits) + 1, (base[i] >> shift) - one)
            m["params"][i] = cell["v"] + one << shift

        if m["type"] >= 2:
            param(2)
            param(3)
            if m["type"] == 3:
                param(4)
                param(5)
            else:
                m["params"][4], m["params"][5] = -m["params"][3], m["params"][2]
        if m["type"] >= 1:
            param(0)
            param(1)


def film_grain(b: Bits, h: Record, s: Record) -> None:
    g = b.part(h, "grain")
    if not s["film_grain"] or not (h["show"] or h["showable"]) or not b.flag(g, "apply"):
        return
    b.f(g, "seed", 16)
    if h["type"] == INTER and not b.flag(g, "update"):
        b.f(g, "from_ref", 3)
        return

    def points(name: str) -> int:
        n = b.f(g, f"n_{name}", 4)
        for p in b.each(g, name, n):
            b.f(p, "x", 8)
            b.f(p, "y", 8)
        values = [p["x"] for p in g[name]]
        if any(v <= u for u, v in zip(values, values[1:], strict=False)):
            raise Malformed(f"{name} points do not increase")
        return n

    points("luma")
    mono, ssx, ssy = s["color"]["mono"], s["color"]["ssx"], s["color"]["ssy"]
    g["from_luma"] = 0 if mono else b.flag(g, "from_luma")
    none = mono or g["from_luma"] or (ssx and ssy and not g["n_luma"])
    for name in ("cb", "cr"):
        if none:
            g[f"n_{name}"], g[name] = 0, []
        else:
            points(name)
    b.f(g, "scaling", 2)
    lag = b.f(g, "lag", 2)
    n = 2 * lag * (lag + 1)
    chroma = n + (1 if g["n_luma"] else 0)
    for key, on, size in (("ar_y", g["n_luma"], n), ("ar_cb", g["from_luma"] or g["n_cb"], chroma), ("ar_cr", g["from_luma"] or g["n_cr"], chroma)):
        for c in b.each(g, key, size if on else 0):
            b.f(c, "v", 8)
    b.f(g, "ar_shift", 2)
    b.f(g, "scale_shift", 2)
    for name in ("cb", "cr"):
        if g[f"n_{name}"]:
            b.f(g, f"{name}_mult", 8)
            b.f(g, f"{name}_luma_mult", 8)
            b.f(g, f"{name}_offset", 9)
    b.flag(g, "overlap")
    b.flag(g, "restricted")


def relative(a: int, b: int, bits: int) -> int:
    d, m = a - b, 1 << bits - 1 if bits else 0
    return (d & m - 1) - (d & m) if bits else 0


def skip_frames(hints: list[int], now: int, bits: int) -> tuple[int, int] | None:
    """The references that skip mode would use: nearest on both sides, or the two nearest before."""
    dist = [relative(x, now, bits) for x in hints]
    fore = max(((d, -k) for k, d in enumerate(dist) if d < 0), default=None)
    back = min(((d, k) for k, d in enumerate(dist) if d > 0), default=None)
    if fore and back:
        return min(-fore[1], back[1]), max(-fore[1], back[1])
    other = max(((d, -k) for k, d in enumerate(dist) if d < fore[0]), default=None) if fore else None
    return (min(-fore[1], -other[1]), max(-fore[1], -other[1])) if other else None


def frame_header(b: Bits, h: Record, s: Record, slots: list[Record | None]) -> None:
    """A frame's header; ``slots`` has the headers of the eight reference slots. Sizes are stated, not taken from references."""
    whole = (1 << SLOTS) - 1
    if s["reduced"]:
        h.update(show_existing=0, type=KEY, show=1, showable=0, error_resilient=1)
    else:
        if b.flag(h, "show_existing"):
            slot = b.f(h, "existing_slot", 3)
            if slots[slot] is None:
                raise Malformed("an empty slot cannot be shown")
            h["refresh"] = whole if slots[slot]["type"] == KEY else 0
            return
        b.f(h, "type", 2)
        if b.flag(h, "show"):
            h["showable"] = int(h["type"] != KEY)
        else:
            b.flag(h, "showable")
        h["error_resilient"] = 1 if h["type"] == SWITCH or h["type"] == KEY and h["show"] else b.flag(h, "error_resilient")
    h["intra"] = int(h["type"] in (KEY, INTRA_ONLY))
    b.flag(h, "no_cdf_update")
    h["screen"] = b.flag(h, "screen") if s["screen_content"] == SELECT else s["screen_content"]
    if h["screen"] and s["integer_mv"] == SELECT:
        b.flag(h, "integer_mv")
    else:
        h["integer_mv"] = s["integer_mv"] if h["screen"] and s["integer_mv"] != SELECT else 0
    if h["intra"]:
        h["integer_mv"] = 1
    h["size_override"] = 1 if h["type"] == SWITCH else 0 if s["reduced"] else b.flag(h, "size_override")
    b.f(h, "hint", s["hint_bits"])
    h["primary"] = PRIMARY_NONE if h["intra"] or h["error_resilient"] else b.f(h, "primary", 3)
    h["refresh"] = whole if h["type"] == SWITCH or h["type"] == KEY and h["show"] else b.f(h, "refresh", 8)
    if h["type"] == INTRA_ONLY and h["refresh"] == whole:
        raise Malformed("an intra-only frame does not refresh all slots")
    h.update(intrabc=0, high_precision=0)
    if h["intra"]:
        frame_size(b, h, s)
        render_size(b, h)
        if h["screen"] and h["upscaled_width"] == h["frame_width"]:
            b.flag(h, "intrabc")
    else:
        refs = b.each(h, "refs", REFS)
        for r in refs:
            if slots[b.f(r, "slot", 3)] is None:
                raise Malformed("a reference is empty")
        frame_size(b, h, s)
        render_size(b, h)
        h["high_precision"] = 0 if h["integer_mv"] else b.flag(h, "high_precision")
        if not b.flag(h, "switchable_filter"):
            b.f(h, "filter", 2)
        b.flag(h, "switchable_motion")
        if not h["error_resilient"] and s.get("ref_mvs"):
            b.flag(h, "use_ref_mvs")
    h["keep_cdfs"] = 0 if s["reduced"] or h["no_cdf_update"] else 1 - b.flag(h, "drop_cdfs")
    tile_info(b, h, s)
    quantisation(b, h, s)
    before = slots[h["refs"][h["primary"]]["slot"]] if h["primary"] != PRIMARY_NONE else None
    segmentation(b, h, before and before["segments"])
    deltas(b, h)
    q = h["quant"]
    plain = not any(q.get(k, 0) for k in ("y_dc", "u_dc", "u_ac", "v_dc", "v_ac"))
    index = [max(0, min(255, q["base"] + f[0])) if on[0] else q["base"] for on, f in zip(h["segments"]["on"], h["segments"]["features"], strict=True)]
    h["lossless"] = int(plain and not any(index))
    h["all_lossless"] = int(h["lossless"] and h["frame_width"] == h["upscaled_width"])
    loop_filter(b, h, s, before and before["loop_filter"])
    cdef(b, h, s)
    restoration(b, h, s)
    if not h["lossless"]:
        b.flag(h, "tx_select")
    h["compound"] = 0 if h["intra"] else b.flag(h, "compound")
    pair = skip_frames([slots[r["slot"]]["hint"] for r in h["refs"]], h["hint"], s["hint_bits"]) if h["compound"] and s.get("order_hint") else None
    h["skip_frames"] = list(pair) if pair else None
    if pair:
        b.flag(h, "skip_mode")
    if not h["intra"] and not h["error_resilient"] and s.get("warped"):
        b.flag(h, "warped_motion")
    b.flag(h, "reduced_tx_set")
    global_motion(b, h, [m["params"] for m in before["motion"]] if before and not h["error_resilient"] else None)
    film_grain(b, h, s)


def read(describe, data: bytes, *context) -> Record:
    record: Record = {}
    describe(Bits(data), record, *context)
    return record


def write(describe, record: Record, *context) -> bytes:
    b = Bits()
    describe(b, record, *context)
    return b.data()


def tile_sizes(data: bytes, tiles: int, size_bytes: int) -> list[bytes]:
    """Tiles of a tile group: all but the last one begin with their size less one, lowest byte first."""
    out, at = [], 0
    for k in range(tiles):
        size = len(data) - at
        if k < tiles - 1:
            if at + size_bytes > len(data):
                raise Malformed("tile size runs past the end")
            size = int.from_bytes(data[at : at + size_bytes], "little") + 1
            at += size_bytes
        if size <= 0 or at + size > len(data):
            raise Malformed("tile runs past the end")
        out.append(data[at : at + size])
        at += size
    return out


def tile_group(tiles: list[bytes], size_bytes: int) -> bytes:
    return b"".join((len(t) - 1).to_bytes(size_bytes, "little") + t for t in tiles[:-1]) + tiles[-1]
