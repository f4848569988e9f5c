"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: w * (1 + slope * (2t - 1)), whose integral is w. Integrals are scaled so that a source's whole demand is its target. A document holds an interval of its source's token stream, in an order fixed by a hash of its id; each pass over the stream repeats it. The inverse of the source's cumulative demand turns the place of a document in the stream into a training position, and rows are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, prefix_sums, shielded, stored, table, unshielded, word_count

WEIGHTS = (1, 2, 3)
SLOPES = (0.5, 0.0, -0.5)
CAP = 3
#: Documents in a bucket of a source's order, on average.
BUCKET = 256
#: A table of sources of up to so many rows is broadcast.
SMALL = 10_000
#: Times that a source takes one copy more or less of the document that brings it nearest to its target.
ROUNDS = 3


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Targets of all sources: shares by weight of the total, at most ``cap`` times a source's size, the excess reshared by weight.

    Sources are ordered by code point, null last, and take the weights in turn. In ascending order of cap * size / weight, sources are capped as long as their share of what is left exceeds their cap.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, share, out = sum(sizes.values()), sum(w.values()), {}
    for s in sorted(names, key=lambda s: (cap * sizes[s] / w[s], names.index(s))):
        out[s] = min(float(cap * sizes[s]), left * w[s] / share)
        if out[s] == cap * sizes[s]:
            left, share = left - cap * sizes[s], share - w[s]
    return out


def sized_documents(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """``docs`` with _size, _key (of the source), _hash (of the id, for the order) and _crc (of the text)."""
    named = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source)))
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return docs.withColumns({"_size": word_count(F.col(text)), "_key": named, "_hash": key, "_crc": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))})


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, slopes=SLOPES, cap: int = CAP, ordered: bool = True, keep_text: bool = True) -> DataFrame:
    """All rows of ``docs`` with _size, _source_size, _target, _copies and _position, range-sorted by position if ``ordered``; without the text if not ``keep_text``.

    _copies, from 0 to ``cap``, is how often the mix takes the document; _position is the training time of its first copy (past 1 if the mix takes none, or takes it to come nearer to the target). Copies k = 0, 1, ... are taken while the middle of the document's interval, k passes on, lies below the target. Then each source ``ROUNDS`` times takes one copy more, or one less, of the document that leaves it nearest to its target, the first in its order among equals, if that is nearer than before.

    The text is scanned once for the sizes, which are stored, and once more if it is kept. The sizes of the sources, a row each, go to the driver. Jobs run while the result is being made.

    Null text: size 0. Null source: a source of its own, ordered last. Null ids come in one place of the order. Equal rows are told apart only by their order, which leaves the same rows either way. An empty table gives an empty result. A very long text is one row like any other. Other columns are kept, whatever their names; those with the names of the operator's own are replaced.
    """
    docs, old, (text, doc_id, source) = shielded(docs, text, doc_id, source)
    spark = docs.sparkSession
    sized = sized_documents(docs, text, doc_id, source)
    own = ["_key", "_size", "_hash", "_crc"]
    if keep_text:
        narrow = stored(sized.select(F.col(doc_id).alias("_id"), *own), "sizes")
    else:
        sized = stored(sized.drop(text), "sizes")
        narrow = sized.select(F.col(doc_id).alias("_id"), *own)
    stats = {r["_key"]: (r["s"], r["n"]) for r in narrow.groupBy("_key").agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()}
    sizes = {k[1:] if k[0] == "+" else None: s for k, (s, _) in stats.items()}
    targets = source_targets(sizes, weights, cap)
    order = {s: i for i, s in enumerate(sorted((x for x in sizes if x is not None)) + [None])}
    rows = [(k, s, targets[x], slopes[order[x] % len(slopes)], -(-n // BUCKET)) for k, (s, n) in stats.items() for x in [k[1:] if k[0] == "+" else None]]
    few = (lambda df: F.broadcast(df)) if len(rows) <= SMALL else (lambda df: df)
    sources = few(spark.createDataFrame(rows, "_key string, _source_size long, _target double, _slope double, _buckets long"))

    dealt = lambda df: df.join(sources, "_key").withColumn("_bucket", F.expr("cast(conv(substr(_hash, 1, 8), 16, 10) as bigint) * _buckets div 4294967296"))
    base = prefix_sums(dealt(narrow).select("_key", "_bucket", "_size"), ["_key"], "_bucket", "_size", "_base")

    def placed(df: DataFrame, key: str) -> DataFrame:
        w = W.partitionBy("_key", "_bucket").orderBy("_hash", F.col(key), "_size", "_crc").rowsBetween(W.unboundedPreceding, -1)
        out = dealt(df).withColumn("_within", F.coalesce(F.sum("_size").over(w), F.lit(0))).join(base, ["_key", "_bucket"])
        out = out.withColumn("_start", F.col("_base") + F.col("_within")).drop("_bucket", "_buckets", "_base", "_within")
        return out.withColumn("_copies", sum((F.when(F.col("_start") + k * F.col("_source_size") + F.col("_size") / 2 < F.col("_target"), 1).otherwise(0) for k in range(cap)), F.lit(0)))

    fill = few(nearer(checkpoint(placed(narrow, "_id").filter("_size > 0").select("_key", "_start", "_size", "_target", "_copies")), cap, few))
    out = placed(sized, doc_id).join(fill, ["_key", "_start", "_size"], "left")
    out = out.withColumns({"_copies": F.col("_copies") + F.coalesce("_delta", F.lit(0)), "_position": position(F.col("_start"))}).drop("_key", "_hash", "_crc", "_delta")
    return unshielded(out.repartitionByRange(F.col("_position"), F.col(doc_id)).sortWithinPartitions("_position", doc_id) if ordered else out, old)


def nearer(placed: DataFrame, cap: int, few) -> DataFrame:
    """_key, _start, _size and _delta: the copies more or less that bring sources nearer to their targets; at most ``ROUNDS`` rows a source. A start and a size above 0 name a row."""
    row = ["_key", "_start", "_size"]
    fill = placed.sparkSession.createDataFrame([], "_key string, _start long, _size long, _delta int")
    for _ in range(ROUNDS):
        now = placed.join(few(fill), row, "left").withColumn("_copies", F.col("_copies") + F.coalesce("_delta", F.lit(0))).drop("_delta")
        gaps = now.groupBy("_key").agg((F.max("_target") - F.sum(F.col("_size") * F.col("_copies")).cast("double")).alias("_gap"))
        able = now.join(few(gaps), "_key").filter(((F.col("_gap") > 0) & (F.col("_copies") < cap)) | ((F.col("_gap") < 0) & (F.col("_copies") > 0)))
        able = able.withColumn("_left", F.abs(F.abs("_gap") - F.col("_size"))).filter(F.col("_left") < F.abs("_gap"))
        best = able.groupBy("_key").agg(F.min(F.struct("_left", "_start", "_size", F.signum("_gap").cast("int").alias("_delta"))).alias("_b"))
        best = best.select("_key", "_b._start", "_b._size", "_b._delta")
        fill = checkpoint(fill.union(best).groupBy(*row).agg(F.sum("_delta").cast("int").alias("_delta")))
    return fill


def position(start):
    """Training time at which a source's cumulative demand reaches ``start``: the root of slope t^2 + (1 - slope) t = start / target."""
    y = F.when(F.col("_target") > 0, start / F.col("_target")).otherwise(F.lit(0.0))
    a = F.col("_slope")
    within = F.least(y, F.lit(1.0))
    t = 2 * within / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * within))
    return F.when(y <= 1, t).otherwise(y)


def take(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The training order itself: each document as often as the mix takes it, with the columns of ``docs``, range-sorted by the positions of the copies.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns are as in ``mix``.
    """
    docs, old, (text, doc_id, source) = shielded(docs, text, doc_id, source)
    columns = docs.columns
    mixed = mix(docs, text, doc_id, source, **options, ordered=False)
    copies = mixed.withColumn("_k", F.explode(F.expr("filter(sequence(0, _copies), k -> k < _copies)")))
    copies = copies.withColumn("_position", position(F.col("_start") + F.col("_k") * F.col("_source_size")))
    return unshielded(copies.repartitionByRange(F.col("_position"), F.col(doc_id)).sortWithinPartitions("_position").select(*columns), old)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, keep_text=False)
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_position").alias("position"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source),
weighted AS (SELECT *, i % 3 + 1 AS w, CASE i % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS a, 3 * s AS cap FROM src),
ranked AS (
  SELECT *, sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(w) OVER (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
         row_number() OVER (ORDER BY cap::DOUBLE / w, i) AS r FROM weighted),
firsts AS (SELECT left_, share, r FROM ranked WHERE left_ * w < cap * share ORDER BY r LIMIT 1),
targets AS (
  SELECT k.source, k.s, k.a, CASE WHEN f.r IS NULL OR k.r < f.r THEN CAST(k.cap AS DOUBLE)
         ELSE CAST(f.left_ * k.w AS DOUBLE) / CAST(f.share AS DOUBLE) END AS target
  FROM ranked k LEFT JOIN firsts f ON true),
starts AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM sized),
placed AS (
  SELECT d.doc_id, d.source, d.size, t.s, t.target, t.a, d.st, CASE WHEN t.target > 0 THEN CAST(d.st AS DOUBLE) / t.target ELSE 0.0 END AS y,
         (CASE WHEN st + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END) + (CASE WHEN st + s + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END)
           + (CASE WHEN st + 2 * s + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END) AS copies
  FROM starts d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
round0 AS (SELECT * FROM placed)""" + "".join(
    f""",
gap{r} AS (SELECT source, max(target) - CAST(sum(size * copies) AS DOUBLE) AS g FROM round{r} GROUP BY source),
best{r} AS (
  SELECT source, st, CAST(sign(g) AS INTEGER) AS delta FROM (
    SELECT c.source, c.st, g, row_number() OVER (PARTITION BY c.source ORDER BY abs(abs(g) - c.size), c.st, c.size) AS k
    FROM round{r} c JOIN gap{r} x ON c.source IS NOT DISTINCT FROM x.source
    WHERE c.size > 0 AND ((g > 0 AND copies < 3) OR (g < 0 AND copies > 0)) AND abs(abs(g) - c.size) < abs(g)) WHERE k = 1),
round{r + 1} AS (SELECT c.* REPLACE (c.copies + coalesce(b.delta, 0) AS copies) FROM round{r} c LEFT JOIN best{r} b ON c.source IS NOT DISTINCT FROM b.source AND c.st = b.st AND c.size > 0)"""
    for r in range(ROUNDS)
) + f"""
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN y <= 1 THEN 2 * least(y, 1.0::DOUBLE) / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * least(y, 1.0::DOUBLE))) ELSE y END AS position
FROM round{ROUNDS}
"""
