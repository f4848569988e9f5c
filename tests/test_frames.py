"""The frame loop over a stream of files against the batch queries."""

import os

import pytest
from pyspark.sql import functions as F

from voxelspark.operators import octree, view
from voxelspark.operators import volume as V
from voxelspark.plans import registry
from voxelspark.sources.shared import written
from voxelspark.streaming.frames import frame_loop

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def test_stream_equals_the_batch_queries(spark, tmp_path):
    events = V.read(spark, SF, "events").filter("event_id < 300")
    source, target = str(tmp_path / "events"), str(tmp_path / "frames")
    bricks = written(registry.seg_palettes(spark, SF).select("brick_id", (F.col("brick_id") % 3 > 0).alias("shown")), "bricks")
    side = V.side(spark, SF)
    for part in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = registry.cameras_of(spark, SF, spark.readStream.schema(events.schema).parquet(source))
        query = frame_loop(stream, bricks, side, V.SEG_BRICK, width=256).writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.frame, r.brick_id, r.lod) for r in spark.read.parquet(target).collect()}
    seen = view.seen_from(registry.seg_palettes(spark, SF), registry.cameras_of(spark, SF, events), V.SEG_BRICK).filter(view.in_frustum(V.SEG_BRICK) & (F.col("brick_id") % 3 > 0))
    want = {(r.frame, r.brick_id, r.lod) for r in seen.select("frame", "brick_id", view.brick_lod(V.SEG_BRICK, width=256).cast("int").alias("lod")).collect()}
    assert got == want and len({f for f, _, _ in got}) > 100


@pytest.mark.parametrize("side", [8, 16, 40])
def test_descent_equals_every_brick(spark, side):
    """Cameras near, in and far from a volume whose octree is not full, with a narrow and a wide view."""
    n = side // 8
    codes = [sum((c >> b & 1) << 3 * b + i for i, c in enumerate((x, y, z)) for b in range(4)) for x in range(n) for y in range(n) for z in range(n) if (x + y * z) % 5 != 4]
    bricks = V.positions(spark.createDataFrame([(c,) for c in codes], "brick_id long"), 8).cache()
    rows = [(k, float(k * 7 % 60 - 10), float(k * 11 % 50 - 5), float(k * 13 % 70 - 15), *v) for k in range(60) for v in [[(1.0, 0.0, 0.0), (0.0, -0.6, 0.8), (-0.48, 0.64, 0.6)][k % 3]]] + [(99, 4.0, 4.0, 4.0, 0.0, 0.0, 1.0)]
    cameras = spark.createDataFrame(rows, "frame long, px double, py double, pz double, dx double, dy double, dz double")
    every = view.seen_from(bricks, cameras, 8).cache()
    for fov in (0.3, 1.2):
        want = {tuple(r) for r in every.filter(view.in_frustum(8, fov)).select("frame", "brick_id").collect()}
        assert {tuple(r) for r in octree.in_view(bricks.select("brick_id"), cameras, side, 8, fov).select("frame", "brick_id").collect()} == want
    want = {(r.frame, r.lod): r.n for r in every.groupBy("frame", view.brick_lod(8, width=64).alias("lod")).agg(F.count("*").alias("n")).collect()}
    assert {(r.frame, r.lod): r.bricks for r in octree.lod_counts(bricks.select("brick_id"), cameras, side, 8, width=64).collect()} == want


def test_no_row_of_a_camera_and_a_brick_is_shuffled(spark, tmp_path):
    """Only bricks, cameras and counts are dealt: descents to what is seen, kept or left have no shuffle above the broadcasts' joins but that of the cameras. Frames that occur twice give their rows as often as the joins of rows do."""
    bricks = written(spark.range(512).select(F.col("id").alias("brick_id")), "bricks")
    poses = [(f, float(f * 7 % 60 - 10), float(f * 11 % 50 - 5), float(f * 13 % 70 - 15), 0.0, -0.6, 0.8) for f in [*range(40), 7, 8, 8, 21]]
    cameras = spark.createDataFrame(poses, "frame long, px double, py double, pz double, dx double, dy double, dz double")
    wanted = octree.in_view(bricks, cameras, 64, 8).select("frame", "brick_id", view.brick_lod(8, width=64).cast("int").alias("lod"))
    assert "Generate" not in wanted._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(frame")[1]
    before, clicks = octree.next_frame(wanted), spark.createDataFrame([(5,), (8,), (9,)], "frame long")
    told = lambda df: [tuple(r) for r in df.select("frame", "brick_id", "lod").collect()]
    for name, want in {"evicted": view.evicted(before, wanted), "requested": view.requested(wanted, before), "work_queue": view.work_queue(wanted, before)}.items():
        got = told(getattr(octree, name)(bricks, cameras, 64, 8, width=64))
        assert got and sorted(got) == sorted(told(want)), name
        assert name != "work_queue" or got == sorted(got)
    got = told(octree.redecoded(bricks, cameras, clicks, 64, 8, width=64))
    assert got == sorted(told(view.redecode(before, clicks))) and got


@pytest.mark.parametrize("side", [16, 32, 64])
def test_a_cube_is_looked_up_once_for_all_that_it_unfolds_to(spark, side):
    """What is made for a brick and a camera is made in generated code, without a look-up or a lambda for each; the order holds in trees of every depth."""
    bricks = written(spark.range((side // 8) ** 3).filter("id % 5 <> 3").select(F.col("id").alias("brick_id")), "bricks")
    poses = [(f, float(f * 7 % 60 - 10), float(f * 11 % 50 - 5), float(f * 13 % 70 - 15), 0.0, -0.6, 0.8) for f in [*range(39, -1, -1), 7, 21]]
    cameras = spark.createDataFrame(poses, "frame long, px double, py double, pz double, dx double, dy double, dz double")
    wanted = octree.in_view(bricks, cameras, side, 8).select("frame", "brick_id", view.brick_lod(8, width=64).cast("int").alias("lod"))
    above, last = wanted._jdf.queryExecution().executedPlan().toString().split("Generate")[:2]
    assert "Join" not in above and "lambda" not in above + last.split("\n")[0]
    every, told = octree.next_frame(cameras).select("frame"), lambda df: [tuple(r) for r in df.select("frame", "brick_id", "lod").collect()]
    for got, want in ((octree.work_queue(bricks, cameras, side, 8, width=64), view.work_queue(wanted, octree.next_frame(wanted))), (octree.redecoded(bricks, cameras, every, side, 8, width=64), view.redecode(octree.next_frame(wanted), every))):
        got = told(got)
        assert got and got == sorted(got) and got == sorted(told(want))


def test_frames_of_one_pose_descend_together(spark):
    """200 frames of four poses, some twice, in two blocks: eight cameras descend, and every frame has its rows."""
    bricks = written(spark.range(64).select(F.col("id").alias("brick_id")), "bricks")
    poses = [(f, float(f % 4 * 9), 5.0, float(f % 4 * 7 - 3), 0.0, -0.6, 0.8) for f in [*range(200), 7, 7, 150]]
    cameras = spark.createDataFrame([*poses, (300, None, 5.0, 5.0, 0.0, -0.6, 0.8)], "frame long, px double, py double, pz double, dx double, dy double, dz double")
    got = octree.frames_in_view(bricks, cameras, 32, 8, block=100).select("frame", "brick_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(frame" in plan and "Generate" not in plan.split("collect_list(frame")[1]
    assert plan.count("REPARTITION_BY_NUM") == 1 and got.rdd.getNumPartitions() == 4
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(map(tuple, octree.in_view(bricks, cameras, 32, 8).select("frame", "brick_id").collect()))
