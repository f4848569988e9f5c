"""The brick cache over a stream of frames: its state is kept by session between micro-batches, as JSON: top, free slots by level, residents (brick, level, slot) and the last accepted camera."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import OUT, BrickCache, step


def stream_residency(frames: DataFrame, capacity: int) -> DataFrame:
    """The stream form of ``replay``: frames of a session must come in order over the batches, and a batch holds whole frames."""

    def run(key, batches, state: GroupState):
        cache, last = BrickCache(capacity), None
        if state.exists:
            cache.top, free, resident, last = json.loads(state.get[0])
            cache.free, cache.resident = {k: v for k, v in free}, {b: (k, slot) for b, k, slot in resident}
        pdf = pd.concat(list(batches))
        rows, last = step(cache, last, pdf)
        last = [float(x) for x in last] if last else None
        state.update((json.dumps([cache.top, sorted(cache.free.items()), [(b, *s) for b, s in cache.resident.items()], last]),))
        out = pd.DataFrame(rows, columns=["frame", "brick_id", "lod", "action", "slot"])
        out.insert(0, "session", key[0])
        yield out.astype({"slot": "Int64"})

    return frames.groupBy("session").applyInPandasWithState(run, OUT, "cache string", "append", GroupStateTimeout.NoTimeout)


def moving_average(frames: DataFrame, window: int = 60) -> DataFrame:
    """Mean of the last ``window`` frame times of each session, of a batch."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    w = W.partitionBy("session").orderBy("frame").rowsBetween(1 - window, 0)
    return frames.withColumns({"mean_ms": F.avg("ms").over(w), "samples": F.count("*").over(w)})
