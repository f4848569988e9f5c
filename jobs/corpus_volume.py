"""A corpus as a volume that a viewer of labelled volumes can show: an incremental job over text documents.

Each document is put into a cell of a 64^3 grid by three measures of its text: its number of words (x), the share of them that are different (y) and their mean length (z). A cell's label is the source that most of its documents come from. The volume is tiled into bricks with all levels of detail and kept in the store of volumes, where the bricks of a span of codes are one partition.

New files of documents come as a stream: each run takes those that the checkpoint does not know, in batches, and ends. A batch adds its counts by cell and source, as a partition of its own, and builds only the spans anew in which it has documents. A batch that is repeated after a failure replaces what it wrote before.

    python -m jobs.corpus_volume --config jobs/corpus_volume.json documents=/data/documents output=/data/volume checkpoint=/data/volume-checkpoint

Settings: ``documents`` (a folder of Parquet files, to which new ones are added, one file, or a pattern of these), ``output`` (folders ``counts`` and ``store``), ``checkpoint`` and ``files_per_batch``.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.common import log_of, main, overwrite, ready, settings
from voxelspark.functions import scalars as S
from voxelspark.operators import volume as V
from voxelspark.plans import registry
from voxelspark.sources import store
from voxelspark.sources.shared import new_folder

SIDE, BRICK, SPAN_BITS = 64, 16, 3
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
COUNTS = "brick_id long, m long, label long, n long, span long, batch long"
KNOWN = {"documents": None, "output": None, "checkpoint": None, "files_per_batch": 200}
LOG = log_of("corpus_volume")


def label_of(source: Column) -> Column:
    """A label of a source: 32 bits of its digest, and 1, as 0 is an empty cell."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(source, F.lit("")), "UTF-8")), 1, 8), 16, 10).cast("long") + 1


def placed(docs: DataFrame) -> DataFrame:
    """x, y, z and label of each document; null texts are empty, and texts without words lie at 0, 0, 0."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select(label_of(F.col("source")).alias("label"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("chars"))
    told = words.select("label", "chars", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("kinds"))
    at = {"x": F.expr("floor(sqrt(n / 2.0D))"), "y": F.expr(f"{SIDE - 1} * kinds div greatest(n, 1)"), "z": F.expr("4 * chars div greatest(n, 1)")}
    return told.select(*(F.least(c.cast("long"), F.lit(SIDE - 1).cast("long")).alias(k) for k, c in at.items()), "label")


def counted(docs: DataFrame) -> DataFrame:
    """The number of documents by brick, cell, label and span."""
    bricks = V.to_bricks(placed(docs), BRICK).groupBy("brick_id", "m", "label").agg(F.count("*").alias("n"))
    return bricks.withColumn("span", store.span_of(F.col("brick_id"), SPAN_BITS))


def majority(counts: DataFrame) -> DataFrame:
    """The label of each cell: that of most documents, the least among equals."""
    summed = counts.groupBy("brick_id", "m", "label").agg(F.sum("n").alias("n"))
    return summed.groupBy("brick_id", "m").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))


def pattern(path: str) -> str:
    """A pattern that only ``path`` meets: file streams take a single file by a pattern alone, and folders either way."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, config: dict) -> DataFrame:
    """Takes all new files, waits for the stream's end and returns the whole store, read back as nodes."""
    c = settings(config, KNOWN)
    out, built = f"{c['output']}/counts", f"{c['output']}/store"
    ready(spark, out, COUNTS, "span", "batch")
    ready(spark, built, store.SCHEMA, "lod", "span")

    def take(docs: DataFrame, batch: int) -> None:
        session = docs.sparkSession
        overwrite(counted(docs).withColumn("batch", F.lit(batch).cast("long")).repartition("span"), out, "span", "batch")
        known = session.read.schema(COUNTS).parquet(out)
        new = known.filter(F.col("batch") == batch)
        n, spans = new.agg(F.sum("n").alias("n"), F.countDistinct("span").alias("spans")).first()
        # At most as many as the grid has spans, 8.
        touched = [r["span"] for r in new.select("span").distinct().collect()]
        cells = majority(known.filter(F.col("span").isin(*touched)))
        store.write(V.pyramid(cells, BRICK), built, SPAN_BITS)
        LOG.info("batch %s: read %s documents, wrote %s of the spans of %s", batch, n or 0, spans, built)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(pattern(c["documents"]))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", c["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%s: %s batches, %s documents in all", c["documents"], sum(p["numInputRows"] > 0 for p in query.recentProgress), spark.read.schema(COUNTS).parquet(out).agg(F.sum("n")).first()[0] or 0)
    return store.voxels(store.read(spark, built), BRICK).filter("label <> 0")


def job2_corpus_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on the whole table of documents, run twice into one new folder and checkpoint: brick_id, lod, m and label of the nodes that are not empty."""
    folder = new_folder(spark, "corpus-volume")
    config = {"documents": f"{sf_dir}/documents.parquet", "output": folder, "checkpoint": f"{folder}/checkpoint"}
    run(spark, config)
    return run(spark, config)


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
JOB2_SQL = f"""WITH w AS (SELECT CAST('0x' || substr(md5(coalesce(source, '')), 1, 8) AS BIGINT) + 1 AS label, CAST(len({_WORDS}) AS BIGINT) AS n, CAST(len(list_distinct({_WORDS})) AS BIGINT) AS kinds, CAST(length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS chars FROM documents),
p AS (SELECT least(CAST(floor(sqrt(n / 2.0::DOUBLE)) AS BIGINT), 63) AS x, least(63 * kinds // greatest(n, 1), 63) AS y, least(4 * chars // greatest(n, 1), 63) AS z, label FROM w),
c AS (SELECT x, y, z, label, count(*) AS n FROM p GROUP BY ALL),
vox AS (SELECT x, y, z, label FROM (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY n DESC, label) AS r FROM c) WHERE r = 1),
{registry.bricks_cte(4)}, {registry.PAD_CTE}, {registry.nodes_cte(4, 'padded')}
SELECT brick_id, lod, m, label FROM nodes WHERE label <> 0"""

if __name__ == "__main__":
    main("corpus_volume", run, "corpus_volume.json")
