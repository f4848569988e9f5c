"""What SQL text can name: table functions for bricks and rays, views of the derived volumes, and the file formats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import codec, rays
from ..operators import volume as V
from ..sources import files
from . import registry


class DecodeBrick:
    """decode_brick(palette, packed, size, lod): m and label of the voxels of a level."""

    def eval(self, palette, packed, size, lod):
        yield from enumerate(codec.decode_brick(list(palette), bytes(packed), size, lod).tolist())


class RaySteps:
    """ray_steps(ox, oy, oz, rx, ry, rz, size, side): the cells of a grid from 0 to ``side`` that a ray crosses, in order."""

    def eval(self, ox, oy, oz, rx, ry, rz, size, side):
        o, r = np.array([[ox, oy, oz]], float), np.array([[rx, ry, rz]], float)
        inverse = np.sign(r) / np.maximum(np.abs(r), rays.EPS)
        ends = np.sort([(0 - o) * inverse, (side - o) * inverse], axis=0)
        t0, t1 = max(0.0, ends[0].max()), ends[1].min()
        if t0 <= t1:
            _, seq, at, begin, end = rays.march(o, r, np.array([t0]), np.array([t1]), np.array([float(size)]), np.full((1, 3), int(side / size)))
            yield from zip(seq.tolist(), *at.T.tolist(), begin.tolist(), end.tolist(), strict=True)


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Names the file formats and table functions in ``spark``, and with ``sf_dir`` the views voxels, bricks, nodes, palettes, encoded, colors and cameras."""
    files.register(spark)
    spark.udtf.register("decode_brick", udtf(DecodeBrick, returnType="m long, label long"))
    spark.udtf.register("ray_steps", udtf(RaySteps, returnType="seq long, cx long, cy long, cz long, t0 double, t1 double"))
    if sf_dir:
        views = {"voxels": V.segmentation, "bricks": registry.seg_bricks, "nodes": registry.seg_nodes, "palettes": registry.seg_palettes, "encoded": registry.encoded, "colors": registry.colors, "cameras": registry.cameras}
        for name, make in views.items():
            make(spark, sf_dir).createOrReplaceTempView(name)
