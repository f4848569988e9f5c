"""Volumes as tables of voxels (x, y, z, label): bricks, pyramids, profiles and level-of-detail views of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import codec
from .order import ranked

SEG_BRICK, PTS, PTS_BRICK = 8, 64, 16
#: Side of the least volume of cells, and its seeds; eight times the seeds have twice the side. Cells reach as far as REACH.
SEG, SEEDS, REACH = 32, 64, 10
#: Side of the blocks that seeds are dealt to.
BLOCK = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(spark: SparkSession, sf_dir: str) -> int:
    """Side of ``segmentation``, which grows with ``supplier``."""
    n, out = read(spark, sf_dir, "supplier").count(), SEG
    while n >= 8 * SEEDS:
        n, out = n / 8, 2 * out
    return out


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell-like volume: each voxel takes the nearest of the seeds, one of each row of ``supplier``, within a distance of 10, else 0. Seeds go to the blocks of voxels that they reach and give their voxels there, beside a row that gives all of a block's, and each voxel keeps the nearest one. Only seeds are shuffled, and none are broadcast, so the work is in proportion to the seeds and the voxels."""
    g = side(spark, sf_dir)
    n, k, turn = g // BLOCK, F.col("s_suppkey").cast("long"), F.floor(F.col("s_suppkey") / g)
    seeds = read(spark, sf_dir, "supplier").select(k.alias("k"), ((7 * k + 3) % g).alias("sx"), ((11 * k + 5 + turn) % g).alias("sy"), ((13 * k + 1 + turn) % g).alias("sz"))
    for c in "xyz":
        reached = F.sequence(F.greatest(F.expr(f"(s{c} - {REACH}) div {BLOCK}"), F.lit(0)), F.least(F.expr(f"(s{c} + {REACH}) div {BLOCK}"), F.lit(n - 1)))
        seeds = seeds.filter(f"s{c} >= {-REACH}").withColumn(f"b{c}", F.explode(reached))
    gap = [F.greatest(F.col(f"b{c}") * BLOCK - F.col(f"s{c}"), F.col(f"s{c}") - F.col(f"b{c}") * BLOCK - (BLOCK - 1), F.lit(0)) for c in "xyz"]
    seeds = seeds.filter(sum(v * v for v in gap) <= REACH**2)
    every = spark.range(n**3).select(*(F.lit(None).cast("long").alias(c) for c in ("k", "sx", "sy", "sz")), *(F.expr(f"id div {n**i} % {n}").alias(f"b{c}") for i, c in enumerate("xyz")))
    parts = min(n**3, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n**3 // 64))
    rows = seeds.unionByName(every).withColumn("block", F.expr(f"bx + {n} * by + {n * n} * bz")).repartition(parts, "block").withColumn("room", F.lit(REACH**2).cast("long"))
    for c in "xyz":
        far = F.floor(F.sqrt("room"))
        first, last = F.col(f"b{c}") * BLOCK, F.col(f"b{c}") * BLOCK + BLOCK - 1
        rows = rows.withColumns({"_from": F.greatest(first, F.col(f"s{c}") - far), "_to": F.least(last, F.col(f"s{c}") + far)}).filter("_from <= _to")
        rows = rows.withColumn(c, F.explode(F.sequence("_from", "_to"))).withColumn("room", F.expr(f"room - coalesce(({c} - s{c}) * ({c} - s{c}), 0)"))
    near = rows.select("block", F.expr(f"x + {g} * y + {g * g} * z").alias("id"), ((REACH**2 - F.col("room")) * (1 << 40) + F.col("k")).alias("d"))
    near = near.groupBy("block", "id").agg(F.min("d").alias("d"))
    label = F.coalesce(F.col("d") % (1 << 40) + 1, F.lit(0)).cast("long").alias("label")
    return near.select((F.col("id") % g).alias("x"), (F.floor(F.col("id") / g) % g).alias("y"), F.floor(F.col("id") / g**2).alias("z"), label)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse volume of the cells that ``lineitem`` hits; the others are 0 and absent."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % PTS).alias("x"), (F.col("l_partkey") % PTS).alias("y"), (F.col("l_suppkey") % PTS).alias("z"), F.col("l_linenumber").cast("long").alias("label"))
    return rows.groupBy("x", "y", "z").agg(F.min("label").alias("label"))


def to_bricks(voxels: DataFrame, size: int) -> DataFrame:
    """brick_id (Morton code of the brick), m (Morton code within it) and label."""
    k = size.bit_length() - 1
    axes = [F.col(c).cast("long") for c in "xyz"]
    return voxels.select(S.morton(*(F.shiftright(a, k) for a in axes)).alias("brick_id"), S.morton(*(a.bitwiseAND(F.lit(size - 1).cast("long")) for a in axes)).alias("m"), "label")


def padded(bricks: DataFrame, size: int) -> DataFrame:
    """``bricks`` with every voxel of each brick that has one; missing ones are 0."""
    arrays = codec.brick_rows(bricks).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), size**3).cast(pa.list_(pa.int64()))], names=["brick_id", "labels"]) for ids, rows in codec.dense(batches, size)), "brick_id long, labels array<long>")
    return arrays.select("brick_id", F.posexplode("labels").alias("m", "label")).withColumn("m", F.col("m").cast("long"))


def fill_counts(bricks: DataFrame, size: int) -> DataFrame:
    """voxels, empty ones and a checksum of each brick as ``padded`` gives it, by counting what is there."""
    there = bricks.groupBy("brick_id").agg(F.count(F.when(F.col("label") != 0, 1)).alias("_n"), F.sum(F.col("label") * (F.col("m") + 1)).alias("checksum"))
    return there.select("brick_id", F.lit(size**3).cast("long").alias("voxels"), (F.lit(size**3) - F.col("_n")).alias("empty"), "checksum")


def pyramid(bricks: DataFrame, size: int) -> DataFrame:
    """Nodes of all levels: brick_id, lod (0 is one voxel), m, label, is_const; absent voxels are 0. A node has the most frequent label of its eight children, the least among equals, and is constant if they are alike and constant. Bricks meet in one shuffle, and a batch of them is reduced level by level."""
    levels = size.bit_length() - 1

    def run(batches):
        for ids, finest in codec.dense(batches, size):
            for lod, (labels, const) in enumerate(zip(*codec.pyramid(finest.reshape(-1), levels), strict=True)):
                per = 1 << 3 * lod
                columns = [np.repeat(ids, per), np.full(len(labels), lod, np.int32), np.tile(np.arange(per), len(ids)), labels, const]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["brick_id", "lod", "m", "label", "is_const"])

    return codec.brick_rows(bricks).mapInArrow(run, "brick_id long, lod int, m long, label long, is_const boolean")


def predicted(bricks: DataFrame, size: int) -> DataFrame:
    """Visited nodes of each brick with the first predictor that gives their label: brick_id, lod, m, op, sign, stop and seq, the place in the brick's stream (the root is 0).

    Parent, then the neighbours out of the 2 x 2 x 2 block along x, y and z (one level up if they come later), then the palette. One shuffle by brick, as in ``pyramid``.
    """
    levels, names = size.bit_length() - 1, pa.array(["parent", "x", "y", "z", "palette"])

    def run(batches):
        for ids, finest in codec.dense(batches, size):
            before = np.ones(len(ids), np.int64)
            for lod, brick, m, op, sign, stop, _ in codec.visited(*codec.pyramid(finest.reshape(-1), levels)):
                count = np.bincount(brick, minlength=len(ids))
                seq = before[brick] + np.arange(len(brick)) - np.repeat(np.cumsum(count) - count, count)
                before += count
                columns = [pa.array(ids[brick]), pa.array(np.full(len(m), lod, np.int32)), pa.array(m), names.take(pa.array(op)), pa.array(sign), pa.array(stop), pa.array(seq)]
                yield pa.RecordBatch.from_arrays(columns, names=["brick_id", "lod", "m", "op", "sign", "stop", "seq"])

    return codec.brick_rows(bricks).mapInArrow(run, "brick_id long, lod int, m long, op string, sign int, stop boolean, seq long")


def grid_codes(spark: SparkSession, side: int) -> DataFrame:
    """The cells of a grid in Morton order: x, y, z, code."""
    cells = spark.range(side**3).select((F.col("id") % side).alias("x"), (F.floor(F.col("id") / side) % side).alias("y"), F.floor(F.col("id") / side**2).alias("z"))
    return cells.withColumn("code", S.morton(F.col("x"), F.col("y"), F.col("z"))).orderBy("code")


def label_counts(voxels: DataFrame) -> DataFrame:
    n = voxels.groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("label", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def label_top(voxels: DataFrame, k: int = 10) -> DataFrame:
    return label_counts(voxels).orderBy(F.desc("n"), "label").limit(k)


def volume_stats(voxels: DataFrame) -> DataFrame:
    return voxels.agg(F.count("*").alias("voxels"), F.countDistinct("label").alias("labels"), F.min("label").alias("least"), F.max("label").alias("most"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("zeros"), *((F.max(c) + 1).cast("long").alias(f"size_{c}") for c in "xyz"))


def palettes(bricks: DataFrame) -> DataFrame:
    """Distinct labels of each brick with the flags and bounds that prune it."""
    out = bricks.groupBy("brick_id").agg(F.sort_array(F.collect_set("label")).alias("palette"), F.min("label").alias("label_min"), F.max("label").alias("label_max"))
    return out.withColumns({"n_labels": F.size("palette").cast("long"), "is_empty": F.forall("palette", lambda p: p == 0)})


def label_sketches(bricks: DataFrame, lg_k: int = 16) -> DataFrame:
    """brick_id and a mergeable sketch of its distinct labels. Its standard error is about 1.04 / sqrt(2^lg_k), 0.4 % for 16; some thousand labels and fewer are kept one by one, so a brick of few labels has a sketch of a few bytes and is counted as it is."""
    return bricks.groupBy("brick_id").agg(F.hll_sketch_agg("label", F.lit(lg_k)).alias("sketch"))


def distinct_by_level(sketches: DataFrame, levels: int) -> DataFrame:
    """level, code and n_labels: estimated distinct labels of each node of the tree of Morton codes, from bricks (level 0) up to the node of ``levels``. A node's sketch is the union of those below, so no label is looked at again; unions are made before and after one shuffle. No bricks give no nodes."""
    above = sketches.select("sketch", "brick_id", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    above = above.withColumn("code", F.expr("shiftright(brick_id, 3 * level)"))
    return above.groupBy("level", "code").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_labels"))


def positions(bricks: DataFrame, size: int) -> DataFrame:
    x, y, z = S.demorton(F.col("brick_id"))
    return bricks.withColumns({"bx": x * size, "by": y * size, "bz": z * size})


def transfer_function(labels: DataFrame) -> DataFrame:
    """idx and rgba of each distinct label but 0, by golden-angle hues in unsigned order of the labels."""
    known = labels.select("label").filter("label <> 0").distinct().withColumn("_order", F.col("label").bitwiseXOR(F.lit(-(1 << 63))))
    places = ranked(known, "_order", "idx").drop("_order")
    i = F.col("idx")
    turns = i * 137.5
    r, g, b = S.hsl_to_rgb(turns - 360 * F.floor(turns / 360), 0.55 + (i % 3) * 0.08, 0.35 + (i % 4) * 0.05)
    dim = lambda c: F.least(F.floor(c * 0.92), F.lit(255))
    return places.withColumn("rgba", S.pack(dim(r), dim(g), dim(b), F.floor((0.25 + (i % 5) * 0.08) * 255)))


def colored(voxels: DataFrame, colors: DataFrame, hidden: DataFrame | None = None, lit: int | None = None) -> DataFrame:
    """rgba of each voxel: its label's colour, else its hash; hidden labels are 0, the highlighted one brighter. The tables of labels grow with the data, so their sizes decide how they are joined."""
    out = voxels.join(colors.select("label", "rgba"), "label", "left")
    out = out.withColumn("rgba", F.coalesce("rgba", S.label_color(F.col("label"))))
    if lit is not None:
        out = out.withColumn("rgba", F.when(F.col("label") == lit, S.highlight(F.col("rgba"))).otherwise(F.col("rgba")))
    if hidden is not None:
        out = out.join(hidden.select("label", F.lit(True).alias("_hidden")).distinct(), "label", "left").withColumn("rgba", F.when(F.col("_hidden"), 0).otherwise(F.col("rgba"))).drop("_hidden")
    return out


def label_index(bricks: DataFrame) -> DataFrame:
    """label and brick_id: which bricks hold a label."""
    return bricks.select("label", "brick_id").distinct()


def recolored(decoded: DataFrame, index: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of ``decoded`` (brick_id, m, label, rgba), bricks that are kept decoded, whose bricks a change of colours touches, with their new colours. ``changes`` has label and rgba (one row a label); the bricks that hold one of its labels are found by ``index`` (label, brick_id), and no other brick is read further than its code."""
    touched = index.join(changes.select("label"), "label", "left_semi").select("brick_id").distinct()
    new = changes.select("label", F.col("rgba").alias("_new"), F.lit(True).alias("_changed"))
    out = decoded.join(touched, "brick_id", "left_semi").join(new, "label", "left")
    return out.select("brick_id", "m", "label", F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("rgba")).alias("rgba"))


def with_changes(decoded: DataFrame, index: DataFrame, changes: DataFrame) -> DataFrame:
    """All of ``decoded`` after the changes: bricks that none of them touches are taken as they are."""
    told = recolored(decoded, index, changes)
    touched = index.join(changes.select("label"), "label", "left_semi").select("brick_id").distinct()
    return decoded.select(*told.columns).join(touched, "brick_id", "left_anti").unionByName(told)


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Matches and mismatches of label by brick, rows of one side only counted as mismatches."""
    both = a.withColumnRenamed("label", "_a").join(b.withColumnRenamed("label", "_b"), keys, "full")
    same = F.when(F.col("_a").eqNullSafe(F.col("_b")), 1).otherwise(0)
    out = both.groupBy("brick_id").agg(F.sum(same).alias("matches"), F.sum(1 - same).alias("mismatches"))
    return out.withColumn("pct", 100.0 * F.col("matches") / (F.col("matches") + F.col("mismatches")))


def first_mismatches(a: DataFrame, b: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` rows in order of ``keys`` whose labels differ: keys, label and other; null where a side has no row."""
    both = a.select(*keys, "label").join(b.select(*keys, F.col("label").alias("other")), keys, "full")
    return both.filter(~F.col("label").eqNullSafe(F.col("other"))).orderBy(*keys).limit(k)
