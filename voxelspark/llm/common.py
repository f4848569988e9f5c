"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a session that runs on this machine alone has none (tests), a folder of its own is set; on a cluster that raises ValueError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return jsc.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, from which later steps read single columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``docs`` with columns whose names begin with "_" renamed, so that an operator's own names are free; the old names by the new ones; and what the columns ``used`` are called now."""
    free = "kept"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    old = {f"{free}{i}": c for i, c in enumerate(docs.columns) if c.startswith("_")}
    new = {c: k for k, c in old.items()}
    return docs.withColumnsRenamed(new) if old else docs, old, [new.get(c, c) for c in used]


def unshielded(out: DataFrame, old: dict[str, str]) -> DataFrame:
    """``out`` with the old names back; a column of the operator's own replaces one of the same name."""
    if not old:
        return out
    own = {c.lower() for c in out.columns if c not in old}
    return out.drop(*(c for c, name in old.items() if name.lower() in own)).withColumnsRenamed(old)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, group: list[str], bucket: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """For each (group, bucket) the sum of ``value`` over the group's smaller buckets.

    Two levels of windows: buckets within runs of ``fan``, and the runs themselves, so that no window holds more than ``fan`` buckets or one row for ``fan`` of them.
    """
    per = df.groupBy(*group, bucket).agg(F.sum(value).alias("_v")).withColumn("_run", F.expr(f"`{bucket}` div {fan}"))
    before = lambda *keys, by: W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    within = per.withColumn("_in", F.coalesce(F.sum("_v").over(before(*group, "_run", by=bucket)), F.lit(0)))
    runs = per.groupBy(*group, "_run").agg(F.sum("_v").alias("_r"))
    runs = runs.withColumn("_base", F.coalesce(F.sum("_r").over(before(*group, by="_run")), F.lit(0))).drop("_r")
    return within.join(runs, [*group, "_run"]).select(*group, bucket, (F.col("_in") + F.col("_base")).alias(out))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow string column (null: empty) one after the other, and their n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches, rows: int = 512, size: int = 4 << 20, column: str = "text"):
    """Arrow record batches cut so that each holds at most ``rows`` rows and, but for single long texts, ``size`` bytes of ``column``."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or total + n > size):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)
