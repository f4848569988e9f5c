"""View queries over bricks: cameras, culling, level of detail, offsets, work queues and visibility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .order import sums_before

FOV = math.pi / 3
MOVED, TURNED = 0.5, 0.05
#: What makes a camera's view, and what a camera before or after it is called beside it.
POSE = ("px", "py", "pz", "dx", "dy", "dz")
OTHER = tuple(f"other_{c}" for c in POSE)


def _center(size: int) -> tuple[Column, Column, Column]:
    return tuple(F.col(c) + size / 2 for c in ("bx", "by", "bz"))


#: Bricks that are broadcast to the cameras, at most.
SMALL = 100_000
#: Rows of cameras and bricks that one task makes, about, where it has to sort them.
ROWS = 1 << 22
#: Numbers of frames in a block, whose frames of one pose are put together.
BLOCK = 1 << 16


def dealt(cameras: DataFrame, *keys: str, each: int = 0, ordered: bool = False) -> DataFrame:
    """``cameras`` by ``keys`` (frame) in as many parts as shuffles have, a number that is named, as they are small before they unfold and would be put together again. With ``each``, the rows that a camera unfolds to, there are more parts if one would make over ``ROWS`` rows; ``ordered`` deals by ranges and sorts."""
    keys = keys or ("frame",)
    n = int(cameras.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if each:
        n = max(n, -(-cameras.count() * each // ROWS))
    return cameras.repartitionByRange(n, *keys).sortWithinPartitions(*keys) if ordered else cameras.repartition(n, *keys)


def together(cameras: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """``cameras`` once for each value of ``keys`` (a pose, and what else tells them apart) and block of frames (``block`` numbers), with ``frames``, those that have it, as often as they have. So what a path seen again takes is its rows. Frames are dealt before they are put together, in one shuffle whose parts stay apart; where no pose recurs, each frame is on its own."""
    own = (*keys, "_block")
    none = F.array_repeat(F.lit(None).cast("long"), F.count("*").cast("int"))
    frames = F.when(F.col("_block").isNull(), none).otherwise(F.collect_list("frame"))
    return dealt(cameras.withColumn("_block", F.floor(F.col("frame") / block)), *own).groupBy(*own).agg(frames.alias("frames"))


def seen_from(bricks: DataFrame, cameras: DataFrame, size: int) -> DataFrame:
    """``bricks`` (with bx, by, bz) and cameras (frame, px, py, pz, dx, dy, dz) with the distance of the centre. Every brick meets each camera, as each has a level and a place in every frame. Cameras are dealt by frame and meet the bricks where they are if these are at most ``SMALL``; else blocks of both meet."""
    n = bricks.count()
    out = dealt(cameras, each=n).crossJoin(F.broadcast(bricks) if n <= SMALL else bricks)
    to = [c - F.col(p) for c, p in zip(_center(size), ("px", "py", "pz"), strict=True)]
    return out.withColumn("distance", S.norm(*to)).withColumn("along", S.dot(to, [F.col(c) for c in ("dx", "dy", "dz")]))


def in_frustum(size: int, fov: float = FOV) -> Column:
    """Whether a brick meets the view cone widened by its angular radius; sin(atan2(r, d)) is r / sqrt(r^2 + d^2). A camera at the centre sees the brick."""
    r = math.sqrt(3) * size / 2
    d = F.col("distance")
    return (d == 0) | (F.try_divide("along", d) >= math.cos(fov / 2) - r / F.sqrt(r * r + d * d))


def palette_visible(hidden: Column) -> Column:
    return F.exists("palette", lambda p: (p != 0) & ~F.array_contains(hidden, p))


def hidden_at(frames: DataFrame, toggles: DataFrame, block: int = 1024) -> DataFrame:
    """session, frame and label of the labels that are hidden in each frame (session, frame): those that the toggles (session, frame, label) up to it switched an odd number of times. An as-of join: each toggle holds until the label's next one, and meets the frames by the session's blocks that it reaches into, so neither a window nor a join holds a session's frames together. Blocks are runs of ``block`` numbers of frames that have a frame or a toggle, put together up to about ``block`` of these, so a session has as many as its rows ask for, however far its frames lie apart."""
    keys, run = ["session", "_run"], F.expr(f"frame div {block}").alias("_run")
    rows = frames.select("session", run).unionByName(toggles.select("session", run))
    ahead = W.partitionBy("session").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = rows.groupBy(keys).agg(F.count("*").alias("_n")).select(*keys, F.floor(F.coalesce(F.sum("_n").over(ahead), F.lit(0)) / block).alias("_block"))
    w = W.partitionBy("session", "label").orderBy("frame")
    until = frames.groupBy("session").agg((F.max("frame") + 1).alias("_last"))
    ends = runs.groupBy("session").agg(F.max("_block").alias("_end"))
    held = toggles.groupBy("session", "label", "frame").agg(F.count("*").alias("_n")).withColumn("_run", run).join(runs, keys)
    held = held.select("session", "label", F.col("frame").alias("_from"), F.lead("frame").over(w).alias("_to"), "_block", F.lead("_block").over(w).alias("_upto"), (F.sum("_n").over(w) % 2).alias("_odd")).filter("_odd = 1")
    held = held.join(until, "session").join(ends, "session").withColumn("_to", F.least("_to", "_last")).filter("_from < _to")
    dealt = held.withColumn("_block", F.explode(F.sequence("_block", F.coalesce("_upto", "_end"))))
    met = frames.withColumn("_run", run).join(runs, keys).join(dealt, ["session", "_block"])
    return met.filter("frame >= _from and frame < _to").select("session", "frame", "label")


def visible_bricks(palettes: DataFrame, hidden: DataFrame) -> DataFrame:
    """brick_id of the bricks that have a label other than 0 and the hidden ones; the table of hidden labels may be of any size."""
    labels = palettes.select("brick_id", F.explode("palette").alias("label")).filter("label <> 0")
    return labels.join(hidden.select("label"), "label", "left_anti").select("brick_id").distinct()


def lod_at(distance: Column, size: int, fov: float = FOV, width: int = 1080) -> Column:
    """The largest level whose voxels are a pixel or more at a distance: 0 is the coarsest. The levels that qualify are counted, as they are the first ones."""
    f = width / 2 / math.tan(fov / 2)
    d = F.greatest(distance, F.lit(0.1))
    return sum((F.when(f * (size / 2**k) / d >= 1, 1).otherwise(0) for k in range(1, size.bit_length())), F.lit(0))


def brick_lod(size: int, fov: float = FOV, width: int = 1080) -> Column:
    return lod_at(F.col("distance"), size, fov, width)


def distance_lod(size: int) -> Column:
    """The level by distance alone: the finest within a brick's size, one less for each doubling, 0 at the least."""
    top = size.bit_length() - 1
    return sum((F.when(F.col("distance") / size <= 2.0 ** (top - k), 1).otherwise(0) for k in range(1, top + 1)), F.lit(0))


def orbit(inputs: DataFrame, center: tuple[float, float, float], radius: float, low: float, high: float, max_pitch: float = math.pi / 3) -> DataFrame:
    """Camera positions of a session's inputs (session, frame, yaw, pitch, zoom: each frame's drags and wheel steps, which add up), looking at ``center``."""
    w = W.partitionBy("session").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    turned = inputs.select("session", "frame", F.sum("yaw").over(w).alias("yaw"), S.clamp(F.sum("pitch").over(w), -max_pitch, max_pitch).alias("pitch"), S.clamp(S.zoomed(F.lit(radius), F.sum("zoom").over(w)), low, high).alias("radius"))
    at = S.orbit_position([F.lit(c) for c in center], F.col("radius"), F.col("yaw"), F.col("pitch"))
    return turned.select("session", "frame", "radius", *(c.alias(n) for c, n in zip(at, ("px", "py", "pz"), strict=True)))


def with_offsets(lods: DataFrame, bricks: int | None = None, most: int = 1 << 20) -> DataFrame:
    """voxels (8^lod) and offset of each brick of a frame, in order of brick_id. Where ``bricks``, the number of bricks, is told and at most ``most``, a frame's rows are one window, which needs no other shuffle than that of the frames; else sums go by runs of bricks."""
    sized = lods.withColumn("voxels", F.pow(F.lit(8.0), F.col("lod")).cast("long"))
    if bricks is None or bricks > most:
        return sums_before(sized, "frame", "brick_id", "voxels", "offset")
    w = W.partitionBy("frame").orderBy("brick_id").rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("voxels").over(w), F.lit(0)))


def lod_histogram(counts: DataFrame) -> DataFrame:
    """``counts`` (frame, lod, bricks, and ``total`` of the frame, else summed here) with their voxels and shares of the frame."""
    n = counts.withColumn("voxels", F.pow(F.lit(8.0), F.col("lod")).cast("long") * F.col("bricks"))
    total = F.col("total") if "total" in counts.columns else F.sum("bricks").over(W.partitionBy("frame"))
    return n.withColumn("pct", 100.0 * F.col("bricks") / total).drop("total")


def evicted(resident: DataFrame, wanted: DataFrame) -> DataFrame:
    return resident.join(wanted.select("frame", "brick_id"), ["frame", "brick_id"], "left_anti")


def requested(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    return candidates.join(requests.select("frame", "brick_id"), ["frame", "brick_id"], "left_semi")


def residency(bricks: DataFrame, resident: DataFrame) -> DataFrame:
    """Each brick with its slot, null where it has none."""
    return bricks.join(resident, "brick_id", "left")


def work_queue(wanted: DataFrame, resident: DataFrame) -> DataFrame:
    """Bricks to decode: those that are not resident at the wanted level, in order."""
    old = resident.select("frame", "brick_id", F.col("lod").alias("_old"))
    return wanted.join(old, ["frame", "brick_id"], "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col("lod"))).drop("_old").orderBy("frame", "brick_id")


def redecode(resident: DataFrame, changes: DataFrame) -> DataFrame:
    """Bricks to decode anew since their colours changed: all that are resident in a frame of ``changes`` (frame), in order."""
    return resident.join(changes.select("frame"), "frame", "left_semi").orderBy("frame", "brick_id")


def moved(a, b) -> bool:
    """Whether camera ``b`` (px, py, pz, dx, dy, dz) differs enough from the last accepted one ``a``; the first one does."""
    if a is None:
        return True
    far = sum((x - y) ** 2 for x, y in zip(a[:3], b[:3], strict=True)) > MOVED * MOVED
    return far or sum(x * y for x, y in zip(a[3:], b[3:], strict=True)) < math.cos(TURNED)
