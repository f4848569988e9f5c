"""Streams whose rows have to be taken in order: the camera trigger and the mean of the last frames.

Rows of a session wait in its state until the watermark has passed them, are then taken in order of time and frame, and update what the session keeps. Timers at the first and the last row of each batch release all that the watermark has passed, so a batch may bring rows in any order within the watermark's delay, and a restart goes on where the checkpoint is.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from ..operators.view import moved

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CAMERA = ("px", "py", "pz", "dx", "dy", "dz")


@contextmanager
def state_store(spark: SparkSession):
    """The state store that timers and lists need, for queries that are started within; what was set before comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """``waiting`` rows (ms, frame and more) and what is ``kept``, both lists in the session's state. A subclass names their columns and takes one row at a time."""

    ROWS = KEPT = ""
    NAMES: tuple[str, ...] = ()

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ms bigint, frame bigint, {self.ROWS}")
        self.kept = handle.getListState("kept", self.KEPT)

    def taken(self, kept: list[tuple], row: tuple) -> tuple[list[tuple], tuple | None]:
        """What is kept after ``row``, and what it gives out."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            ms = part["ts"].astype("datetime64[ms]").astype("int64")
            new += list(zip(ms, *(part[c] for c in self.names()), strict=True))
        if new:
            self.waiting.appendList([(int(r[0]), int(r[1]), *map(float, r[2:])) for r in new])
            for ms in {int(min(r[0] for r in new)), int(max(r[0] for r in new))}:
                self.handle.registerTimer(ms)
        return iter(())

    def names(self) -> list[str]:
        return ["frame", *(c.split()[0] for c in self.ROWS.split(", "))]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in waiting if r[0] < upto], [r for r in waiting if r[0] >= upto]
        kept, out = [tuple(r) for r in self.kept.get()], []
        for row in ready:
            kept, told = self.taken(kept, row)
            if told is not None:
                out.append((key[0], row[1], *told))
        self.kept.put(kept) if kept else self.kept.clear()
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["session", "frame", *self.NAMES])

    def close(self) -> None:
        pass


class Trigger(InOrder):
    """Keeps the camera that was accepted last; gives out frames whose camera differs enough from it."""

    ROWS = KEPT = ", ".join(f"{c} double" for c in CAMERA)
    NAMES = CAMERA

    def taken(self, kept, row):
        camera = row[2:]
        return ([camera], camera) if moved(kept[0] if kept else None, camera) else (kept, None)


class Rolling(InOrder):
    """Keeps the times of the last frames, at most ``LENGTH``; gives out their number and mean with each frame."""

    LENGTH = 60
    ROWS = KEPT = "cost double"
    NAMES = ("samples", "mean_ms")

    def taken(self, kept, row):
        kept = [*kept, row[2:]][-self.LENGTH :]
        return kept, (len(kept), sum(c for (c,) in kept) / len(kept))


def _stream(events: DataFrame, late: str, processor: InOrder, schema: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy("session").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def camera_trigger(cameras: DataFrame, late: str) -> DataFrame:
    """The frames of a stream of cameras (session, frame, ts, px, py, pz, dx, dy, dz) in which the camera has moved or turned enough since the frame before of which that was true; the first one of a session counts. Rows are told once the watermark, ``late`` behind the latest, has passed them."""
    return _stream(cameras.select("session", "frame", "ts", *CAMERA), late, Trigger(), "session long, frame long, " + Trigger.ROWS)


def rolling_mean(frames: DataFrame, late: str) -> DataFrame:
    """samples and mean_ms, the number and mean of the last 60 times up to each frame of a stream (session, frame, ts, ms)."""
    return _stream(frames.selectExpr("session", "frame", "ts", "ms as cost"), late, Rolling(), "session long, frame long, samples long, mean_ms double")
