"""The store of a volume: Parquet, partitioned by level and by span of Morton codes, sorted by code within.

A span is a cube of bricks, as a prefix of their code is. A box of the volume is covered by a few ranges of codes, which prune partitions by span and row groups by the bounds of the codes in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

SCHEMA = "lod int, span long, brick_id long, labels array<long>, palette array<long>, label_min long, label_max long, is_empty boolean"
#: Bits of a code below its span: 3 for each doubling of its side, so 2^3 bricks an axis.
SPAN_BITS = 9


def span_of(brick_id, bits: int = SPAN_BITS):
    return F.shiftright(brick_id, bits)


def rows_of(nodes: DataFrame, bits: int = SPAN_BITS) -> DataFrame:
    """A row for each brick and level of ``nodes`` (brick_id, lod, m, label): its labels in order of m (one if all are alike), its palette and bounds."""
    told = nodes.groupBy("lod", "brick_id").agg(F.sort_array(F.collect_list(F.struct("m", "label"))).alias("v"))
    labels = F.col("v.label")
    palette = F.sort_array(F.array_distinct(labels))
    out = told.select(F.col("lod").cast("int").alias("lod"), span_of(F.col("brick_id"), bits).alias("span"), "brick_id", labels.alias("labels"), palette.alias("palette"))
    out = out.withColumn("labels", F.when(F.size("palette") == 1, F.col("palette")).otherwise(F.col("labels")))
    return out.withColumns({"label_min": F.array_min("palette"), "label_max": F.array_max("palette"), "is_empty": F.forall("palette", lambda p: p == 0)})


def write(nodes: DataFrame, path: str, bits: int = SPAN_BITS) -> None:
    """Writes the levels and spans that ``nodes`` has; others of the store stay. Every row of a span must be among them."""
    rows = rows_of(nodes, bits).repartition("lod", "span").sortWithinPartitions("lod", "span", "brick_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lod", "span").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def voxels(rows: DataFrame, size: int) -> DataFrame:
    """brick_id, lod, m and label of every node of ``rows``."""
    n = F.pow(F.lit(8.0), F.col("lod")).cast("int")
    labels = F.when(F.size("labels") == 1, F.array_repeat(F.col("labels")[0], n)).otherwise(F.col("labels"))
    return rows.select("brick_id", "lod", F.posexplode(labels).alias("m", "label")).withColumn("m", F.col("m").cast("long"))


def covering(low: tuple[int, int, int], high: tuple[int, int, int], bits: int, most: int = 64) -> list[tuple[int, int]]:
    """Ranges (first, last) of codes of ``bits`` bits an axis that cover the box of cells from ``low`` to ``high``, both in it. Cubes are cut until they are inside, or there are about ``most``; what they cover beyond the box is small and is left to a later test."""
    whole, cut = [], [(0, 0, 0, 0, bits)]
    while cut and len(whole) + len(cut) + 7 <= most:
        code, *at, k = cut.pop(0)
        side = 1 << k
        if any(a > h or a + side - 1 < l for a, l, h in zip(at, low, high, strict=True)):
            continue
        if k == 0 or all(a >= l and a + side - 1 <= h for a, l, h in zip(at, low, high, strict=True)):
            whole.append((code << 3 * k, (code + 1 << 3 * k) - 1))
            continue
        half = side // 2
        cut += [(code * 8 + c, *(a + half * (c >> i & 1) for i, a in enumerate(at)), k - 1) for c in range(8)]
    meets = lambda at, k: all(a <= h and a + (1 << k) - 1 >= l for a, l, h in zip(at, low, high, strict=True))
    whole += [(code << 3 * k, (code + 1 << 3 * k) - 1) for code, *at, k in cut if meets(at, k)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(whole):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def read_box(spark: SparkSession, path: str, low: tuple[int, int, int], high: tuple[int, int, int], lod: int, size: int, bits: int = SPAN_BITS) -> DataFrame:
    """Bricks of level ``lod`` that meet the box of voxels from ``low`` to ``high``, both in it."""
    least, most = tuple(c // size for c in low), tuple(c // size for c in high)
    ranges = covering(least, most, max(1, max(most).bit_length()))
    spans = sorted({s for a, b in ranges for s in (a >> bits, b >> bits)})
    near = F.lit(False)
    for a, b in ranges:
        near = near | F.col("span").between(a >> bits, b >> bits) & F.col("brick_id").between(a, b)
    rows = read(spark, path).filter(F.col("lod") == lod).filter(F.col("span").between(spans[0], spans[-1]) & near if ranges else F.lit(False))
    at = S.demorton(F.col("brick_id"))
    inside = F.lit(True)
    for c, l, h in zip(at, least, most, strict=True):
        inside = inside & c.between(l, h)
    return rows.filter(inside)
