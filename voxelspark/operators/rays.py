"""Ray queries: rays of a camera, the bricks and voxels they cross, and front-to-back compositing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import written

EPS = 1e-6


def rays(spark: SparkSession, camera: DataFrame, width: int, height: int, fov: float = math.pi / 3) -> DataFrame:
    """A ray for each pixel: px, py, origin (ox, oy, oz), unit direction (rx, ry, rz). ``camera`` is one row."""
    grid = spark.range(width * height).select((F.col("id") % width).alias("px"), F.floor(F.col("id") / width).alias("py"))
    basis = camera.select(F.col("px").alias("ox"), F.col("py").alias("oy"), F.col("pz").alias("oz"), *(c.alias(f"{n}{i}") for n, v in zip("fru", S.camera_basis([F.col("dx"), F.col("dy"), F.col("dz")]), strict=True) for i, c in enumerate(v)))
    t = math.tan(fov / 2)
    nx, ny = (F.col("px") + 0.5) / width * 2 - 1, 1 - (F.col("py") + 0.5) / height * 2
    e = F.struct(*((F.col(f"f{i}") + F.col(f"r{i}") * nx * (width / height * t) + F.col(f"u{i}") * ny * t).alias(f"e{i}") for i in range(3)))
    d = S.let(e, lambda v: F.struct(*(c.alias(n) for c, n in zip(S.normalized(v["e0"], v["e1"], v["e2"]), ("rx", "ry", "rz"), strict=True))))
    return grid.crossJoin(F.broadcast(basis)).select("px", "py", "ox", "oy", "oz", d.alias("d")).select("px", "py", "ox", "oy", "oz", "d.rx", "d.ry", "d.rz")


def inverse(c: Column) -> Column:
    return F.when(c < 0, -1.0).when(c > 0, 1.0).otherwise(0.0) / F.greatest(F.abs(c), F.lit(EPS))


def slab(rows: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """t_in and t_out of each ray through a box, and whether it hits."""
    names = ("ox", "oy", "oz"), ("rx", "ry", "rz")

    def spans(v: Column) -> Column:
        near, far = [], []
        for o, r, a, b in zip(*names, low, high, strict=True):
            i = inverse(v[r])
            t1, t2 = (a - v[o]) * i, (b - v[o]) * i
            near.append(F.least(t1, t2))
            far.append(F.greatest(t1, t2))
        return F.struct(F.greatest(*near, F.lit(0.0)).alias("a"), F.least(*far).alias("b"))

    out = rows.withColumn("_t", S.let(F.struct(*(F.col(c) for n in names for c in n)), spans))
    return out.select(*rows.columns, F.col("_t.a").alias("t_in"), F.col("_t.b").alias("t_out"), (F.col("_t.a") <= F.col("_t.b")).alias("hit"))


def march(o: np.ndarray, r: np.ndarray, t0: np.ndarray, t1: np.ndarray, size: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells along rays, all rays a step at a time: ray, seq, cell (n x 3), t_in, t_out, in order of ray and seq. ``size`` is the side of a ray's cells and ``limit`` (n x 3) their number by axis.

    A step goes along x if its boundary is strictly the nearest, else along y if nearer than z, else along z.
    """
    t = t0 + np.maximum(t0 * 1e-6, 1e-5)
    at = np.clip(np.floor((o + r * t[:, None]) / size[:, None]).astype(np.int64), 0, limit - 1)
    sign = np.where(r >= 0, 1, -1)
    inverse_ = sign / np.maximum(np.abs(r), EPS)
    ahead = ((at + (sign > 0)) * size[:, None] - o) * inverse_
    delta = np.abs(inverse_) * size[:, None]
    begin, seq, found = t0.astype(float).copy(), np.zeros(len(t0), np.int64), []
    on = np.flatnonzero(begin < t1)
    while len(on):
        n = ahead[on]
        axis = np.where((n[:, 0] < n[:, 1]) & (n[:, 0] < n[:, 2]), 0, np.where(n[:, 1] < n[:, 2], 1, 2))
        end = np.minimum(n[np.arange(len(on)), axis], t1[on])
        hit = end > begin[on]
        found.append((on[hit], seq[on[hit]], at[on[hit]], begin[on[hit]], end[hit]))
        seq[on[hit]] += 1
        begin[on] = np.maximum(begin[on], end)
        at[on, axis] += sign[on, axis]
        ahead[on, axis] += delta[on, axis]
        on = on[(begin[on] < t1[on]) & (at[on] >= 0).all(1) & (at[on] < limit[on]).all(1)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 3), np.int64), np.zeros(0), np.zeros(0)
    out = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort((out[1], out[0]))
    return tuple(c[order] for c in out)


def _marched(rows: DataFrame, keep: str, size, limit, low=None) -> DataFrame:
    """Cells of each row's ray (ox .. rz, t_in, t_out): the columns ``keep`` (DDL), seq, cx, cy, cz, t0, t1. ``size`` and ``limit`` are numbers, or the names of columns; ``low`` names the columns of the grid's corner."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(frames):
        for pdf in frames:
            n = len(pdf)
            o, r = pdf[["ox", "oy", "oz"]].to_numpy(float), pdf[["rx", "ry", "rz"]].to_numpy(float)
            o = o - pdf[low].to_numpy(float) if low else o
            sizes = pdf[size].to_numpy(float) if isinstance(size, str) else np.full(n, float(size))
            limits = np.repeat(pdf[limit].to_numpy(np.int64)[:, None], 3, 1) if isinstance(limit, str) else np.broadcast_to(np.array(limit, np.int64), (n, 3))
            ray, seq, at, begin, end = march(o, r, pdf["t_in"].to_numpy(float), pdf["t_out"].to_numpy(float), sizes, limits)
            yield pd.DataFrame({**{c: pdf[c].to_numpy()[ray] for c in names}, "seq": seq, "cx": at[:, 0], "cy": at[:, 1], "cz": at[:, 2], "t0": begin, "t1": end})

    return rows.mapInPandas(run, f"{keep}, seq long, cx long, cy long, cz long, t0 double, t1 double")


def crossed(hits: DataFrame, size: float, limit: tuple[int, int, int]) -> DataFrame:
    """The cells of a grid that each ray of ``hits`` crosses, in order: px, py, seq, cx, cy, cz, t0, t1. Narrow: a ray unfolds where it is, to at most the sum of the grid's sides."""
    return _marched(hits.filter("hit"), "px long, py long", size, limit)


def opacity(alpha: Column, stride: Column | float) -> Column:
    """Opacity over ``stride`` unit steps."""
    return S.clamp(1 - F.pow(1 - alpha, stride), 0.0, 1.0)


def transmitted(samples: DataFrame, least: float = 0.05, full: float = 0.95) -> DataFrame:
    """The samples (px, py, seq, alpha) that a pixel's ray takes in, with ``through``, what is left of the light before them: those with alpha up to ``least`` are skipped and those behind an opacity over ``full`` are not reached."""
    w = W.partitionBy("px", "py").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    through = F.exp(F.coalesce(F.sum(F.ln(F.greatest(1 - F.col("alpha"), F.lit(1e-12)))).over(w), F.lit(0.0)))
    return samples.filter(F.col("alpha") > least).withColumn("through", through).filter(1 - F.col("through") <= full)


def composite(samples: DataFrame, least: float = 0.05, full: float = 0.95) -> DataFrame:
    """r, g, b, a of each pixel from samples (px, py, seq, r, g, b, alpha) front to back, as ``transmitted`` takes them in."""
    share = F.col("alpha") * F.col("through")
    return transmitted(samples, least, full).groupBy("px", "py").agg(*(F.sum(F.col(c) * share).alias(c) for c in "rgb"), F.sum(share).alias("a"))


def until_opaque(path: DataFrame, tinted: DataFrame, least: float = 0.05, full: float = 0.95, first: int = 2) -> tuple[DataFrame | None, list[int]]:
    """The samples that rays take in, with ``through``, what is left of the light before each, and their number in each slab.

    Rays advance by slabs of the bricks on their ``path`` (px, py, bseq, brick_id, lod, stride, cells, the brick's corner, the ray and its part in the brick), ``first`` bricks and then twice as many each time. A ray whose opacity is over ``full`` is left out of the next slab, and only bricks that the others meet are looked up among ``tinted`` (brick_id, lod, m, r, g, b, own). What a slab found is written, as the next one starts from it.
    """
    far = path.agg(F.max("bseq")).first()[0]
    through, out, counts, at, width = None, [], [], 0, first
    w = W.partitionBy("px", "py").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    while far is not None and at <= far:
        part = path.filter((F.col("bseq") >= at) & (F.col("bseq") < at + width))
        part = part.withColumn("start", F.lit(1.0)) if through is None else part.join(through, ["px", "py"], "left").withColumn("start", F.coalesce("through", F.lit(1.0))).drop("through").filter(1 - F.col("start") <= full)
        steps = _marched(part, "px long, py long, bseq long, brick_id long, lod int, stride double, bx long, by long, bz long, start double", "stride", "cells", ["bx", "by", "bz"])
        placed = steps.withColumn("m", _code(F.col("cx"), F.col("cy"), F.col("cz")))
        near = tinted.join(part.select("brick_id").distinct(), "brick_id", "left_semi")
        met = placed.join(near, ["brick_id", "lod", "m"]).withColumns({"seq": F.col("bseq") * 1_000_000 + F.col("seq"), "alpha": opacity(F.col("own"), F.col("stride"))})
        met = met.filter((F.col("own") > least) & (F.col("alpha") > least))
        left = F.exp(F.coalesce(F.sum(F.ln(F.greatest(1 - F.col("alpha"), F.lit(1e-12)))).over(w), F.lit(0.0)))
        seen = written(met.withColumn("through", F.col("start") * left).filter(1 - F.col("through") <= full).drop("start"), "ray-samples")
        after = seen.groupBy("px", "py").agg(F.min(F.col("through") * (1 - F.col("alpha"))).alias("through"))
        through = written((after if through is None else after.unionByName(through)).groupBy("px", "py").agg(F.min("through").alias("through")), "ray-light")
        counts.append(seen.count())
        out.append(seen)
        at, width = at + width, 2 * width
    whole = None
    for seen in out:
        whole = seen if whole is None else whole.unionByName(seen)
    return whole, counts


def tints(nodes: DataFrame, levels: DataFrame, colors: DataFrame) -> DataFrame:
    """The nodes of each brick's level in ``levels`` (brick_id, lod) that have a label other than 0, with r, g, b and own, their alpha, in 0 to 1."""
    known = nodes.select("brick_id", F.col("lod").cast("int").alias("lod"), "m", "label").join(levels, ["brick_id", "lod"]).filter("label <> 0").join(colors.select("label", "rgba"), "label")
    r, g, b, a = (c / 255.0 for c in S.unpack(F.col("rgba")))
    return known.select("brick_id", "lod", "m", r.alias("r"), g.alias("g"), b.alias("b"), a.alias("own"))


def paths(spark: SparkSession, levels: DataFrame, camera: DataFrame, side: int, brick: int, width: int, height: int) -> DataFrame:
    """The bricks of ``levels`` that the rays of a camera cross, in order of bseq, with what marching through one needs."""
    ray = rays(spark, camera, width, height)
    path = crossed(slab(ray, (0.0,) * 3, (float(side),) * 3), float(brick), (side // brick,) * 3)
    corner = [(F.col(f"c{c}") * brick).alias(f"b{c}") for c in "xyz"]
    path = path.select("px", "py", F.col("seq").alias("bseq"), _code(F.col("cx"), F.col("cy"), F.col("cz")).alias("brick_id"), *corner, F.col("t0").alias("t_in"), F.col("t1").alias("t_out"))
    directed = path.join(levels, "brick_id").join(ray, ["px", "py"])
    return directed.withColumns({"stride": F.lit(float(brick)) / F.pow(F.lit(2.0), F.col("lod")), "cells": F.pow(F.lit(2.0), F.col("lod")).cast("long")})


def render(spark: SparkSession, nodes: DataFrame, levels: DataFrame, colors: DataFrame, camera: DataFrame, side: int, brick: int, width: int, height: int, light: tuple = S.light_direction(25)) -> DataFrame:
    """Packed rgba of every pixel, 0 where nothing is hit.

    Rays cross bricks; in each that is not empty they cross the cells of its level of detail, of ``levels`` (brick_id, lod, is_empty), whose labels are those of ``nodes`` (brick_id, lod, m, label). A sample counts as its cell is wide (``opacity``), and rays stop where they are opaque (``until_opaque``). Samples of a cell's alpha over 0.35 are shaded by the gradient, and over 0.4 shadowed by what stands towards the light, before they are composited. Equi-joins by brick, level and code; rays unfold where they are. Levels, tints and paths are written once, as several steps read them.
    """
    shown = written(levels.filter(~F.col("is_empty")).select("brick_id", F.col("lod").cast("int").alias("lod")), "ray-levels")
    tinted = written(tints(nodes, shown, colors), "ray-tints")
    pixels = spark.range(width * height).select((F.col("id") % width).alias("px"), F.floor(F.col("id") / width).alias("py"))
    seen, _ = until_opaque(written(paths(spark, shown, camera, side, brick, width, height), "ray-paths"), tinted)
    if seen is None:
        return pixels.withColumn("rgba", F.lit(0).cast("long"))

    alphas = tinted.select("brick_id", "lod", "m", F.col("own").alias("alpha"))
    slopes = lod_gradients(alphas, shown, brick, side, only=seen.filter("own > 0.35")).select("brick_id", "lod", "m", "gx", "gy", "gz")
    lit = seen.filter("own > 0.35").join(slopes, ["brick_id", "lod", "m"])
    world = {c: F.col(f"b{c}") + F.col(f"c{c}") * F.col("stride") for c in "xyz"}
    n = F.greatest(S.norm(F.col("gx"), F.col("gy"), F.col("gz")), F.lit(0.001))
    lit = written(lit.select("px", "py", "seq", "own", "through", "gx", "gy", "gz", *(v.cast("long").alias(c) for c, v in world.items()), *((-F.col(f"g{c}") / n).alias(f"n{c}") for c in "xyz")), "ray-slopes")
    points = lit.filter("own > 0.4").select(F.struct("px", "py", "seq").alias("id"), "x", "y", "z", "nx", "ny", "nz", "through")
    found = shadows(points, alphas, light, side, brick=brick, levels=shown).select("id.*", "shadow")
    factor = lit.join(found, ["px", "py", "seq"], "left").select("px", "py", "seq", F.coalesce("shadow", F.lit(1.0)).alias("shadow"), shade([F.col(f"g{c}") for c in "xyz"], light, shadow=F.coalesce("shadow", F.lit(1.0))).alias("light"))
    toned = seen.join(factor, ["px", "py", "seq"], "left")
    tones = shadowed([F.col(c) for c in "rgb"], F.coalesce("shadow", F.lit(1.0)))
    toned = toned.select("px", "py", "alpha", "through", *((t * F.coalesce("light", F.lit(1.0))).alias(c) for c, t in zip("rgb", tones, strict=True)))
    share = F.col("alpha") * F.col("through")
    image = toned.groupBy("px", "py").agg(*(F.sum(F.col(c) * share).alias(c) for c in "rgb"), F.sum(share).alias("a"))
    byte = lambda c: F.floor(F.coalesce(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) * 255)
    return pixels.join(image, ["px", "py"], "left").select("px", "py", S.pack(byte("r"), byte("g"), byte("b"), byte("a")).alias("rgba"))


def bricks_hit(spark: SparkSession, camera: DataFrame, side: int, brick: int, width: int, height: int) -> DataFrame:
    """Codes of the bricks that any ray crosses."""
    path = crossed(slab(rays(spark, camera, width, height), (0.0,) * 3, (float(side),) * 3), float(brick), (side // brick,) * 3)
    return path.select(S.morton(F.col("cx"), F.col("cy"), F.col("cz")).alias("brick_id")).distinct()


def first_hits(samples: DataFrame) -> DataFrame:
    return samples.groupBy("px", "py").agg(F.min_by(F.struct("seq", "alpha", "r", "g", "b"), "seq").alias("first"))


def gathered(cells: DataFrame, keys: list[str], moves: dict[str, list[Column]]) -> DataFrame:
    """keys, alpha and the alpha of each neighbour of ``cells`` (keys, alpha). ``moves`` says, by name, the cell that takes a cell's alpha under that name; null keys take none. Every cell sends its own alpha, so one shuffle serves all neighbours."""
    own = F.coalesce("alpha", F.lit(0.0))
    sent = [F.struct(*(F.col(k).cast("long").alias(k) for k in keys), F.lit(n).alias("as"), own.alias("a")) if to is None else F.struct(*(c.cast("long").alias(k) for k, c in zip(keys, to, strict=True)), F.lit(n).alias("as"), own.alias("a")) for n, to in {"alpha": None, **moves}.items()]
    dealt = cells.select(F.explode(F.array(*sent)).alias("s")).select("s.*").dropna(subset=keys)
    return dealt.groupBy(*keys).agg(*(F.max(F.when(F.col("as") == n, F.col("a"))).alias(n) for n in ("alpha", *moves))).filter("alpha is not null")


def gradients(alphas: DataFrame, least: float | None = None) -> DataFrame:
    """x, y, z, alpha and the central differences gx, gy, gz of alpha at every voxel of ``alphas`` (x, y, z, alpha); absent neighbours are 0. With ``least``, a neighbour of an alpha up to it counts as the voxel's own, so that gradients do not point at what is not seen."""
    moves = {f"{c}_{name}": [F.col(k) + (step if k == c else 0) for k in "xyz"] for c in "xyz" for name, step in (("up", -1), ("down", 1))}
    out = gathered(alphas, ["x", "y", "z"], moves)
    at = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if least is None else F.when(F.col(c) > least, F.col(c)).otherwise(F.col("alpha"))
    return out.select("x", "y", "z", "alpha", *(((at(f"{c}_up") - at(f"{c}_down")) / 2).alias(f"g{c}") for c in "xyz"))


def _code(*at: Column) -> Column:
    """A Morton code to join by, -1 of null places: a key that cannot be null is not tested for it, and that test would repeat the whole expression in the plan."""
    return F.coalesce(S.morton(*at), F.lit(-1).cast("long"))


def _beside(cells: DataFrame, brick: int, side: int, faces: bool) -> DataFrame:
    """For each of the ``cells`` (brick_id, lod, cx, cy, cz in cells of its level) and each of its six sides the voxel (wx, wy, wz) of its corner, moved by a cell, that lies in the volume; with ``faces`` only those out of the brick."""
    n, stride = F.expr("shiftleft(1L, lod)"), F.expr(f"shiftright({brick}L, lod)")
    low = dict(zip("xyz", (c * brick for c in S.demorton(F.col("brick_id"))), strict=True))
    placed = cells.select("brick_id", "lod", "cx", "cy", "cz", n.alias("n"), stride.alias("stride"), *(v.alias(f"b{c}") for c, v in low.items()))
    moved = []
    for c in "xyz":
        for name, step in (("up", 1), ("down", -1)):
            to = F.col(f"c{c}") + step
            at = F.struct(F.lit(f"{c}_{name}").alias("as"), *((F.col(f"b{k}") + (to if k == c else F.col(f"c{k}")) * F.col("stride")).alias(f"w{k}") for k in "xyz"))
            moved.append(F.when((to < 0) | (to >= F.col("n")), at) if faces else at)
    out = placed.select("brick_id", "lod", "cx", "cy", "cz", F.explode(F.array_compact(F.array(*moved))).alias("q")).select("brick_id", "lod", "cx", "cy", "cz", "q.*")
    return out.filter(inside(F.col("wx"), F.col("wy"), F.col("wz"), side))


def _answered(asked: DataFrame, nodes: DataFrame, levels: DataFrame, brick: int) -> DataFrame:
    """``asked`` (any columns, and a voxel wx, wy, wz) with a, the alpha of the node there: that of the voxel's brick, at the brick's own level. Voxels without a node drop out. The brick is found by its code, the node by brick, level and code."""
    k = brick.bit_length() - 1
    home = _code(*(F.shiftright(f"w{c}", k) for c in "xyz"))
    there = asked.withColumn("home", home).join(levels.select(F.col("brick_id").alias("home"), F.col("lod").alias("home_lod")), "home")
    cell = _code(*(F.expr(f"shiftright(w{c} & {brick - 1}, {k} - home_lod)") for c in "xyz"))
    found = nodes.select(F.col("brick_id").alias("home"), F.col("lod").alias("home_lod"), F.col("m").alias("home_m"), F.coalesce("alpha", F.lit(0.0)).alias("a"))
    return there.withColumn("home_m", cell).join(found, ["home", "home_lod", "home_m"]).drop("home", "home_lod", "home_m", "wx", "wy", "wz")


def lod_gradients(nodes: DataFrame, levels: DataFrame, brick: int, side: int, least: float = 0.05, only: DataFrame | None = None) -> DataFrame:
    """brick_id, lod, m, alpha, gx, gy, gz of ``nodes`` (brick_id, lod, m, alpha), each brick at its own level of ``levels`` (brick_id, lod), in steps of that level's cells; or of the cells of ``only`` (brick_id, lod, m) alone.

    A neighbour in another brick is what that brick has, at its level, where the cell's corner lies when moved by a cell. A neighbour out of the volume, absent or of an alpha up to ``least`` counts as the node's own, so that gradients do not point at what is not seen. Cells within a brick send their alphas to each other in one shuffle; only those at its faces ask other bricks.
    """
    keys = ["brick_id", "lod", "cx", "cy", "cz"]
    at = [a.alias(f"c{c}") for c, a in zip("xyz", S.demorton(F.col("m")), strict=True)]
    nodes, levels = (df.withColumn("lod", F.col("lod").cast("int")) for df in (nodes, levels))
    placed = nodes.select("brick_id", "lod", *at, F.coalesce("alpha", F.lit(0.0)).alias("a"))
    if only is None:
        cells, inner = placed, []
        n = F.expr("shiftleft(1L, lod)")
        for c in "xyz":
            for name, step in (("up", -1), ("down", 1)):
                to = F.col(f"c{c}") + step
                sent = F.struct("brick_id", "lod", *((to if k == c else F.col(f"c{k}")).alias(f"c{k}") for k in "xyz"), F.lit(f"{c}_{name}").alias("as"), "a")
                inner.append(F.when((to >= 0) & (to < n), sent))
        own = F.struct(*keys, F.lit("alpha").alias("as"), "a")
        told = placed.select(F.explode(F.array_compact(F.array(own, *inner))).alias("s")).select("s.*")
    else:
        cells = only.select("brick_id", F.col("lod").cast("int").alias("lod"), "m").distinct().select("brick_id", "lod", *at)
        told = placed.join(cells, keys, "left_semi").select(*keys, F.lit("alpha").alias("as"), "a")
    # Nodes grow with the volume, whatever size the planner takes them to have, so they are not broadcast.
    told = told.unionByName(_answered(_beside(cells, brick, side, only is None), nodes.hint("merge") if only is None else nodes, levels, brick))
    names = ["alpha", *(f"{c}_{n}" for c in "xyz" for n in ("up", "down"))]
    out = told.groupBy(*keys).agg(*(F.max(F.when(F.col("as") == n, F.col("a"))).alias(n) for n in names)).filter("alpha is not null")
    safe = lambda c: F.when(F.col(c) > least, F.col(c)).otherwise(F.col("alpha"))
    return out.select("brick_id", "lod", _code(*(F.col(f"c{c}") for c in "xyz")).alias("m"), "alpha", *(((safe(f"{c}_up") - safe(f"{c}_down")) / 2).alias(f"g{c}") for c in "xyz"))


def trilinear(points: DataFrame, nodes: DataFrame, values: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """id and the blend of ``values`` over the eight cells around each point, by their nearness; 0 where all are absent.

    ``points`` has id, brick_id, lod and the place in the brick in cells of that level (cx, cy, cz); ``nodes`` has brick_id, lod, m (one row each) and the values. Cells past the brick's far faces are its last ones. The cells of a brick and level are one array, which each of its points reads, so a point is one row that is shuffled once. Nodes grow with the volume, whatever size the planner takes them to have, so they are not broadcast.
    """
    cell, n = F.struct("m", *values), F.expr("shiftleft(1, 3 * cast(lod as int))")
    packed = nodes.filter("m is not null").groupBy("brick_id", "lod").agg(F.sort_array(F.collect_list(cell)).alias("_some"))
    there = F.map_from_entries(F.transform("_some", lambda c: F.struct(c["m"].alias("k"), c.alias("v"))))
    every = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.try_element_at(there, i))
    packed = packed.select("brick_id", "lod", F.when(F.size("_some") == n, F.col("_some")).otherwise(every).alias("_cells"))
    last, low = F.pow(F.lit(2.0), F.col("lod")).cast("long") - 1, {c: F.floor(F.col(f"c{c}")).cast("long") for c in "xyz"}
    placed = points.select("id", "brick_id", "lod", S.morton(*(F.least(low[c], last) for c in "xyz")).alias("_m"), *((low[c] < last).alias(f"_in{c}") for c in "xyz"), *((F.col(f"c{c}") - low[c]).alias(f"_{c}") for c in "xyz"))
    out = placed.join(packed.hint("merge"), ["brick_id", "lod"], "left")
    steps = {}
    for i, c in enumerate("xyz"):
        mask = sum(1 << 3 * k + i for k in range(21))
        own = F.col("_m").bitwiseAND(F.lit(mask))
        steps[c] = own, F.when(F.col(f"_in{c}"), (own.bitwiseOR(F.lit(~mask)) + 1).bitwiseAND(F.lit(mask))).otherwise(own)
    near = []
    for k in range(8):
        bits = {c: k >> i & 1 for i, c in enumerate("xyz")}
        at = sum((steps[c][t] for c, t in bits.items()), F.lit(0).cast("long"))
        near.append(F.struct(at.try_cast("int").alias("at"), math.prod(F.col(f"_{c}") if t else 1 - F.col(f"_{c}") for c, t in bits.items()).alias("w")))
    # Lambdas, at which Spark ends a stage's generated method: one method for all corners is too large to be compiled.
    met = F.transform(F.array(*near), lambda q: F.struct(q["w"].alias("w"), F.when(q["w"] > 0, F.get("_cells", q["at"])).alias("v")))
    out = out.select("id", F.filter(met, lambda q: q["v"].isNotNull()).alias("_met"))
    total = F.aggregate("_met", F.lit(0.0), lambda s, q: s + q["w"])
    blend = lambda v: F.aggregate("_met", F.lit(0.0), lambda s, q: s + F.coalesce(q["v"][v] * q["w"], F.lit(0.0)))
    return out.select("id", *(F.coalesce(F.try_divide(blend(v), total), F.lit(0.0)).alias(v) for v in values))


def shade(g, light: tuple, ambient: float = 0.5, diffuse: float = 0.8, shadow: Column | float = 1.0) -> Column:
    """Light factor of a gradient: ambient plus diffuse along the normal towards the light, whose length does not count, from 0.3 (lit) or 0.1 (unlit) to 1."""
    n, far = F.greatest(S.norm(*g), F.lit(0.001)), math.sqrt(sum(c * c for c in light))
    along = -(g[0] * (light[0] / far) + g[1] * (light[1] / far) + g[2] * (light[2] / far)) / n
    low = F.when(along > 0.01, 0.3).otherwise(0.1)
    return F.least(F.greatest(ambient + F.greatest(along, F.lit(0.0)) * diffuse * shadow, low), F.lit(1.0))


def shadowed(rgb, shadow: Column) -> list[Column]:
    """Colours in shadow: up to half of the way to four fifths of their luminance and a fifth of themselves."""
    grey = rgb[0] * 0.299 + rgb[1] * 0.587 + rgb[2] * 0.114
    share = S.clamp(1 - shadow, 0.0, 1.0) * 0.5
    return [c * (1 - share) + (grey * 0.8 + c * 0.2) * share for c in rgb]


def shadows(points: DataFrame, alphas: DataFrame, light: tuple, side: int, least: int = 24, most: int = 64, full: float = 0.8, brick: int | None = None, levels: DataFrame | None = None) -> DataFrame:
    """shadow of each point (id, voxel x, y, z, unit normal nx, ny, nz, and ``through``, the light that is left where the view ray meets it).

    The ray starts 0.6 along the normal from the voxel's middle and takes max(least, most * through) unit steps towards the light from half a step on, as far as the volume's edge. Its shadow is 0 if the alphas on its way sum to over ``full``, else exp(-1.5 sum), mixed with 1 by ``through``. A point whose light is nearly gone (below 0.1) or hardly touched (over 0.8) is lit: no ray. ``alphas`` has x, y, z and alpha, or with ``levels`` (brick_id, lod) brick_id, lod, m and alpha of the nodes of each brick's level. Rays unfold in the JVM and meet their voxels in equi-joins.
    """
    n = math.sqrt(sum(c * c for c in light))
    count = F.greatest(F.lit(least), F.floor(F.lit(float(most)) * F.col("through"))).cast("int")
    asked = points.filter("through >= 0.1 and 1 - through >= 0.2")
    at = asked.select("id", "x", "y", "z", "nx", "ny", "nz", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    at = at.select("id", *(F.floor(F.col(c) + 0.5 + F.col(f"n{c}") * 0.6 + (F.col("k") + 0.5) * (d / n)).alias(c) for c, d in zip("xyz", light, strict=True)))
    at = at.filter(inside(*(F.col(c) for c in "xyz"), side))
    if levels is None:
        met = at.join(alphas.select("x", "y", "z", "alpha").hint("merge"), ["x", "y", "z"])
    else:
        home = _code(*(F.floor(F.col(c) / brick) for c in "xyz"))
        within = at.withColumn("brick_id", home).join(levels.select("brick_id", "lod"), "brick_id")
        stride = F.lit(float(brick)) / F.pow(F.lit(2.0), F.col("lod"))
        met = within.withColumn("m", _code(*(F.floor((F.col(c) % brick) / stride) for c in "xyz"))).join(alphas.select("brick_id", "lod", "m", "alpha"), ["brick_id", "lod", "m"])
    summed = met.groupBy("id").agg(F.sum("alpha").alias("_sum"))
    total = F.coalesce("_sum", F.lit(0.0))
    asks = (F.col("through") >= 0.1) & (1 - F.col("through") >= 0.2)
    value = F.when(~asks, 1.0).when(total > full, 0.0).otherwise(1 + (F.exp(-1.5 * total) - 1) * F.col("through"))
    return points.select("id", "through").join(summed, "id", "left").select("id", value.alias("shadow"))


def inside(x: Column, y: Column, z: Column, side: int) -> Column:
    """Whether a voxel lies in the volume."""
    return (x >= 0) & (x < side) & (y >= 0) & (y < side) & (z >= 0) & (z < side)


def over_black(rgba: Column) -> Column:
    r, g, b, a = S.unpack(rgba)
    down = lambda c: F.floor(c * a / 255)
    return S.pack(down(r), down(g), down(b), F.lit(255))
