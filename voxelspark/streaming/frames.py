"""The frame loop as one streaming query: from cameras to the bricks that each frame asks for, with their levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import octree, view


def frame_loop(cameras: DataFrame, bricks: DataFrame, side: int, size: int, hidden_too: bool = False, width: int = 1080) -> DataFrame:
    """session, frame, brick_id, lod and voxels of what each frame of a stream of cameras (session, frame, px .. dz) has in view.

    Stateless: each batch's cameras descend the octree over ``bricks`` (brick_id, and ``shown`` where labels are hidden), a table that is read anew by each batch, so a brick that is shown or hidden between batches counts from the next one on. With ``hidden_too`` bricks that are not shown are asked for as well.
    """
    known = bricks.drop("shown") if hidden_too else bricks
    seen = octree.in_view(known, cameras, side, size)
    lod = view.brick_lod(size, width=width).cast("int")
    return seen.select("session", "frame", "brick_id", lod.alias("lod")).withColumn("voxels", F.pow(F.lit(8.0), F.col("lod")).cast("long"))
