"""Ordered streams against plain loops, over batches out of order and a restart."""

import datetime as dt
import random

import pytest

from voxelspark.operators.view import moved
from voxelspark.streaming import ordered

START = dt.datetime(2024, 1, 1)
END = dt.datetime(2025, 1, 1)
COLUMNS = "session long, frame long, ts timestamp, px double, py double, pz double, dx double, dy double, dz double, ms double"


def events(rng, n):
    out = []
    for s in range(3):
        at = [0.0, 0.0, 0.0]
        for f in range(n):
            at = [c + rng.choice([0.0, 0.1, 0.3]) for c in at]
            out.append((s, f, START + dt.timedelta(seconds=f), *at, *((1.0, 0.0, 0.0) if rng.random() < 0.9 else (0.6, 0.8, 0.0)), float(rng.randrange(31))))
    return out


def run(spark, make, source, target, check):
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(source)
    with ordered.state_store(spark):
        query = make(stream, "30 seconds").writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()


def plain(rows):
    """(accepted cameras, rolling means) of all sessions."""
    accepted, means, last, kept = set(), {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        s, f, camera = r[0], r[1], r[3:9]
        if moved(last.get(s), camera):
            accepted.add((s, f, *camera))
            last[s] = camera
        kept[s] = [*kept.get(s, []), r[9]][-60:]
        means[s, f] = (len(kept[s]), sum(kept[s]) / len(kept[s]))
    return accepted, means


def test_streams_equal_plain_loops(spark, tmp_path):
    rng = random.Random(9)
    rows = events(rng, 90)
    source, before = str(tmp_path / "in"), spark.conf.get(ordered.PROVIDER)
    put = lambda some: spark.createDataFrame(some, COLUMNS).coalesce(1).write.mode("append").parquet(source)
    # Rows come up to 20 seconds out of order, and the stream is started anew after each file.
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 20))
    end = [(9, 0, END, *[0.0] * 6, 0.0)]
    for part in (late[:150], late[150:], end):
        put(part)
        for name, make in (("trigger", ordered.camera_trigger), ("rolling", ordered.rolling_mean)):
            run(spark, make, source, str(tmp_path / name), str(tmp_path / f"{name}-check"))
    accepted, means = plain(rows)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "trigger")).collect()}
    assert got == accepted and 10 < len(accepted) < len(rows)
    got = {(r.session, r.frame): (r.samples, r.mean_ms) for r in spark.read.parquet(str(tmp_path / "rolling")).collect()}
    assert got.keys() == means.keys() and all(got[k] == pytest.approx(v) for k, v in means.items())
    assert spark.conf.get(ordered.PROVIDER) == before
