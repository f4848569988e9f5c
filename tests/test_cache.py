import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelspark.operators import view
from voxelspark.operators import volume as V
from voxelspark.operators.cache import BrickCache, BrickTable, replay, replay_views
from voxelspark.streaming.residency import moving_average, stream_residency

SCHEMA = "session long, frame long, px double, py double, pz double, dx double, dy double, dz double, brick_id long, lod int, visible boolean"


def test_slots_are_reused_by_level_and_never_overlap():
    cache = BrickCache(3 * 512)
    for frame in range(60):
        wanted = {b: (b + frame // 7) % 4 for b in range(frame % 5, frame % 5 + 4)}
        told = cache.update(wanted)
        spans = sorted((s, s + 8**k) for k, s in cache.resident.values() if s >= 0)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(b <= cache.capacity for _, b in spans)
        assert {b for b, _, a, _ in told if a in ("keep", "decode", "rebuild")} == set(cache.resident) <= set(wanted)
    cache.compact()
    assert cache.stats()["free"] == 0


def test_full_cache_rebuilds_and_then_refuses():
    cache = BrickCache(512 + 64)
    assert [a for *_, a, _ in cache.update({1: 3})] == ["decode"]
    assert [a for *_, a, _ in cache.update({2: 3})] == ["evict", "decode"]
    assert sorted(a for *_, a, _ in cache.update({2: 3, 3: 3})) == ["rebuild", "refuse"]


def rows():
    out = []
    for frame in range(8):
        angle = frame * 0.03
        for b in range(5):
            out.append((1, frame, float(frame // 3), 0.0, 0.0, math.cos(angle), math.sin(angle), 0.0, b + frame // 3, (b + frame) % 3, b != frame))
    return out


def test_stream_equals_replay(spark, tmp_path):
    whole = pd.DataFrame(replay(spark.createDataFrame(rows(), SCHEMA), 200).collect())
    for k in range(4):
        part = [r for r in rows() if r[1] // 2 == k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = stream_residency(files, 200).writeStream.outputMode("append").format("memory").queryName("residency").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    from voxelspark.streaming.windows import phase_timings

    assert {"addBatch", "triggerExecution"} <= {phase for _, phase, ms in phase_timings(query) if ms >= 0}
    query.stop()
    got = pd.DataFrame(spark.sql("select * from residency").collect())
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, whole.values.tolist())) and len(got)
    assert len(set(got[1])) < 8  # frames with a camera at rest change nothing


def test_tables_of_bricks_equal_the_cache():
    rng = np.random.default_rng(3)
    for capacity in (0, 64, 600, 1200, 5000):
        cache, table = BrickCache(capacity), BrickTable(capacity, 30)
        for _ in range(150):
            want = np.where(rng.random(30) < rng.random(), rng.integers(0, 4, 30), -1).astype(np.int8)
            got = [(int(b), int(k), a, None if s is None else int(s[i])) for a, at, lods, s in table.update(want) for i, (b, k) in enumerate(zip(at, lods))]
            assert sorted(got, key=str) == sorted(cache.update({b: int(k) for b, k in enumerate(want) if k >= 0}), key=str)
            assert table.top == cache.top and {k: v for k, v in table.free.items() if v} == {k: v for k, v in cache.free.items() if v}


def test_views_replay_without_rows_of_cameras_and_bricks(spark):
    """Sessions of several tasks, a null one, cameras at rest and at a brick's centre: as ``replay`` over every frame and brick."""
    bricks = V.positions(spark.range(0, 64, 3).select(F.col("id").alias("brick_id")), 8)
    poses = [(s, f, *((float((f // 2 * k + j) % 50 - 9) for j, k in enumerate((7, 11, 13)))), *((0.0, -0.6, 0.8) if f % 3 else (1.0, 0.0, 0.0))) for s in (1, 2, 7, None) for f in range(s or 0, 40)] + [(9, 1, 4.0, 4.0, 4.0, 0.0, 0.0, 0.0)]
    cameras = spark.createDataFrame(poses, "session long, frame long, px double, py double, pz double, dx double, dy double, dz double").repartition(5)
    seen = view.seen_from(bricks, cameras, 8).withColumn("lod", view.brick_lod(8, width=64).cast("int")).withColumn("visible", view.in_frustum(8))
    for capacity in (200, 3000):
        want, got = replay(seen, capacity), replay_views(bricks, cameras, capacity, 8, width=64)
        assert got.schema == want.schema
        rows = sorted(map(str, want.collect()))
        assert sorted(map(str, got.collect())) == rows and len(rows) > 500
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_moving_average(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(100)], "session long, frame long, ms double")
    last = moving_average(df).filter("frame = 99").first()
    assert last.samples == 60 and last.mean_ms == sum(range(40, 100)) / 60


def test_windows_of_a_stream(spark, tmp_path):
    from voxelspark.streaming.windows import event_counts

    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "click", h * 7 + m) for h in range(4) for m in range(0, 60, 9)]
    events = spark.createDataFrame(rows, "at string, event_type string, user_id long").selectExpr("cast(at as timestamp) as ts", "event_type", "user_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = event_counts(stream, "1 hour", late="10 minutes").writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    whole = {(r.start, r.n, r.users) for r in event_counts(events, "1 hour").collect()}
    got = {(r.start, r.n, r.users) for r in spark.sql("select * from hours").collect()}
    assert len(whole) == 4 and got < whole and len(got) == 3  # the last window may still get late events


def test_display_and_growth(spark, tmp_path):
    from voxelspark.functions.scalars import grown
    from voxelspark.sources.files import write_ppm

    assert [grown(0, 10, 4), grown(16, 10, 4), grown(10, 40, 4)] == [14, 16, 53]
    write_ppm(spark.createDataFrame([(0, 0, 1), (1, 0, 255 * 256), (1, 1, 255 * 65536 + 7)], "px int, py int, rgba long"), str(tmp_path / "i.ppm"), 2, 2)
    assert (tmp_path / "i.ppm").read_bytes() == b"P6 2 2 255\n" + bytes([1, 0, 0, 0, 255, 0, 0, 0, 0, 7, 0, 255])
