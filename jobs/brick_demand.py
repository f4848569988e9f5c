"""Which bricks of a volume its viewers ask for: a batch job over a log of camera events.

For each day and hour it tells how many frames had a brick in view at each level of detail, and how many voxels that were, so that what is asked for most can be kept decoded and near. The task that has an hour looks at each of its poses and adds up what they see, or, for volumes of more than ``octree.SHARED`` levels, frames meet bricks by a descent of the octree. Bricks of hidden labels are taken out before.

    python -m jobs.brick_demand --config jobs/brick_demand.json tables=/data/sf1 output=/data/demand

Settings: ``tables`` (a folder with events, supplier and nation tables), ``output``, ``days`` (a list of days to do, or null for all), ``brick`` (side) and ``width`` (of the image, for levels of detail). Output: Parquet partitioned by day, replaced day by day, so a run that is repeated leaves the same.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.common import log_of, main, overwrite, ready, settings
from voxelspark.operators import octree, poses, view
from voxelspark.operators import volume as V
from voxelspark.plans import registry
from voxelspark.sources.shared import new_folder, written

SCHEMA = "hour int, brick_id long, lod int, frames long, voxels long, day string"
KNOWN = {"tables": None, "output": None, "days": None, "brick": V.SEG_BRICK, "width": 256}
LOG = log_of("brick_demand")


def demand(spark: SparkSession, tables: str, days: list[str] | None, brick: int, width: int) -> DataFrame:
    """The job's rows, each day's in one part and in order."""
    events = V.read(spark, tables, "events").filter(F.col("ts").isNotNull())
    if days is not None:
        events = events.filter(F.to_date("ts").isin(*[F.lit(d).cast("date") for d in days]))
    at = events.select(F.col("event_id").alias("frame"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"))
    # Frames of an hour whose cameras are alike count together, and an hour's are dealt to one task, which counts what they see.
    cameras = registry.cameras_of(spark, tables, events).join(at, "frame").groupBy("day", "hour", *octree.POSE).agg(F.count("*").alias("n"))
    # The bricks with a label that is not hidden, written once, as each level of the descent reads them.
    palettes = V.palettes(V.to_bricks(V.segmentation(spark, tables), brick))
    bricks = written(view.visible_bricks(palettes, registry.hidden(spark, tables)), "shown-bricks")
    side = V.side(spark, tables)
    if octree.depth(side, brick) <= octree.SHARED:
        counted = poses.counted(bricks, cameras, brick, width, {"day": "string", "hour": "int"}, "day")
    else:
        seen = octree.in_view(bricks, cameras, side, brick, keys=("day", "hour"))
        lod = view.brick_lod(brick, width=width).cast("int").alias("lod")
        counted = seen.select("day", "hour", "brick_id", lod, "n").groupBy("day", "hour", "brick_id", "lod").agg(F.sum("n").alias("frames"))
        counted = counted.repartition("day").sortWithinPartitions("day", "hour", "brick_id", "lod")
    voxels = F.col("frames") * F.pow(F.lit(8.0), F.col("lod")).cast("long")
    return counted.select("hour", "brick_id", "lod", "frames", voxels.alias("voxels"), "day")


def run(spark: SparkSession, config: dict) -> DataFrame:
    """Does the job and returns its whole output, read back."""
    c = settings(config, KNOWN)
    read, wrote = Observation(), Observation()
    n = V.read(spark, c["tables"], "events").select(F.count("*").alias("events"), F.count("ts").alias("dated")).observe(read, F.max("events").alias("events"), F.max("dated").alias("dated"))
    n.collect()
    LOG.info("read %s: %s events, %s of them with a time, days %s", c["tables"], read.get["events"], read.get["dated"], c["days"] or "all")
    rows = demand(spark, c["tables"], c["days"], c["brick"], c["width"])
    ready(spark, c["output"], SCHEMA, "day")
    overwrite(rows.observe(wrote, F.count("*").alias("rows"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames")), c["output"], "day")
    LOG.info("wrote %s: %s rows, %s bricks in view", c["output"], wrote.get["rows"], wrote.get["frames"])
    return spark.read.schema(SCHEMA).parquet(c["output"])


def job1_brick_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on whole tables, run twice into one new folder."""
    config = {"tables": sf_dir, "output": new_folder(spark, "brick-demand")}
    run(spark, config)
    return run(spark, config)


JOB1_SQL = f"""{registry.SEEN}, {registry.HIDDEN},
shown AS (SELECT DISTINCT brick_id FROM bricks WHERE label <> 0 AND label NOT IN (SELECT label FROM hidden))
SELECT CAST(extract(hour FROM ts) AS INTEGER) AS hour, brick_id, lod, count(*) AS frames, CAST(sum(1 << (3 * lod)) AS BIGINT) AS voxels, strftime(ts, '%Y-%m-%d') AS day
FROM wanted JOIN shown USING (brick_id) JOIN events ON event_id = frame WHERE ts IS NOT NULL GROUP BY ALL"""

if __name__ == "__main__":
    main("brick_demand", run, "brick_demand.json")
