"""Stateful stream processing: reference slots, refitted rate models and late headers of many streams at once.

Each stream (key) has its own state in the state store; order within a stream is a number in its rows, and a
row that is not later than the last one is an error row, since the order of frames is authoritative. The
batch twins are in ``tessera.operators.streams``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

SLOTS = 8


class SlotProcessor(StatefulProcessor):
    """Reference slots: for each frame what the slots held before it; then the frame goes to the slots of its mask."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", StructType([StructField("slot", LongType())]), StructType([StructField("frame", LongType())]))
        self.last = handle.getValueState("last", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        last = self.last.get()[0] if self.last.exists() else -1
        frames = pd.concat(list(rows)).sort_values("n", kind="stable")
        held = {k: self.slots.getValue((k,))[0] if self.slots.containsKey((k,)) else None for k in range(SLOTS)}
        for n, mask in zip(frames["n"].tolist(), frames["mask"].tolist(), strict=True):
            if n <= last:
                out.append((key[0], n, *[None] * SLOTS, "out of order"))
                continue
            out.append((key[0], n, *[held[k] for k in range(SLOTS)], None))
            held.update({k: n for k in range(SLOTS) if mask >> k & 1})
            last = n
        for k, n in held.items():
            if n is not None:
                self.slots.updateValue((k,), (n,))
        self.last.update((last,))
        columns = ["stream", "n", *[f"slot{k}" for k in range(SLOTS)], "error"]
        yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in columns[:-1]})

    def close(self) -> None:
        pass


SLOT_SCHEMA = StructType([StructField("stream", LongType()), StructField("n", LongType()), *[StructField(f"slot{k}", LongType()) for k in range(SLOTS)], StructField("error", StringType())])


def slots(frames: DataFrame, mode: str = "Update") -> DataFrame:
    """stream, n, slot0 ..., error from a stream of rows (stream, n, mask)."""
    return frames.groupBy("stream").transformWithStateInPandas(statefulProcessor=SlotProcessor(), outputStructType=SLOT_SCHEMA, outputMode=mode, timeMode="None")


class RefitProcessor(StatefulProcessor):
    """Rate model: each observation weighs half; what is owed grows by the share and falls by the bits."""

    def __init__(self, target: float, weight: float = 0.5):
        self.target, self.weight = target, weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("k", DoubleType()), StructField("owed", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        k, owed = self.state.get() if self.state.exists() else (None, 0.0)
        frames, out = pd.concat(list(rows)).sort_values("n", kind="stable"), []
        for n, observed, bits in zip(frames["n"].tolist(), frames["observed"].tolist(), frames["bits"].tolist(), strict=True):
            k = observed if k is None else (1 - self.weight) * k + self.weight * observed
            owed += self.target - bits
            out.append((key[0], n, k, owed))
        self.state.update((k, owed))
        yield pd.DataFrame(out, columns=["stream", "n", "k", "owed"])

    def close(self) -> None:
        pass


REFIT_SCHEMA = StructType([StructField("stream", LongType()), StructField("n", LongType()), StructField("k", DoubleType()), StructField("owed", DoubleType())])


def refits(frames: DataFrame, target: float, mode: str = "Update") -> DataFrame:
    """stream, n, k, owed from a stream of rows (stream, n, observed, bits)."""
    return frames.groupBy("stream").transformWithStateInPandas(statefulProcessor=RefitProcessor(target), outputStructType=REFIT_SCHEMA, outputMode=mode, timeMode="None")
