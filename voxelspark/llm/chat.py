"""Chat formatting with collapse of cumulative snapshots.

Logged conversations often repeat an earlier log and add turns. A rolling hash of each prefix of turns finds the conversations that begin longer ones; an anti-join keeps the maximal conversations, one of each group of equal ones; then the turns of these alone are rendered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def maximal_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each maximal conversation: conv_id, n_turns, n_copies and text (rendered).

    A conversation is dropped if all its turns (roles and texts) are the first turns of a longer one. Of equal ones the one with the smallest id stays, and n_copies counts them. Turns go by number, then role, then text, nulls first; repeated rows are repeated turns. Null role and null text are values of their own, rendered as "unknown" and as nothing. Rows of null conv_id are one conversation. An empty table gives an empty result; other columns are left out.

    The hash of a prefix is the sum, modulo nothing, of 128 hashed bits of (place, role, text) of its turns, in four sums of 32 bits that cannot overflow; so a window computes it in one pass, and equal prefixes have equal hashes wherever they stand. A conversation is one row of the result, so it must fit a task; groups of equal conversations or of equal prefixes are counted, never gathered.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    kind = turns.select(F.col(conv)).schema[0].dataType
    rows = turns.select(mark(conv).alias("key"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    # The one shuffle of the texts serves all that follows, as every branch asks for the same four columns.
    rows = rows.repartition(parts(turns.sparkSession), "key")
    named = F.when(F.col("key") != "-", F.substr("key", F.lit(2))).cast(kind)
    ordered = W.partitionBy("key").orderBy("turn", "role", "text")
    hashed = rows.withColumn("k", F.row_number().over(ordered))
    hashes = {"h1": F.xxhash64("k", mark("role"), mark("text")), "h2": F.xxhash64(mark("text"), F.lit(7), mark("role"), "k")}
    running = W.partitionBy("key").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    half = lambda h, high: F.shiftrightunsigned(h, 32) if high else F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))
    sums = [F.sum(half(h, high)).over(running).cast("string") for h in hashes for high in (True, False)]
    hashed = hashed.withColumns(hashes).withColumns({"prefix": F.concat_ws(":", "k", *sums), "last": F.lead("k").over(ordered).isNull()})

    prefixes = hashed.filter(~F.col("last")).select("prefix").distinct()
    whole = hashed.filter("last").groupBy("prefix").agg(F.min(named).alias("conv_id"), F.max("k").cast("long").alias("n_turns"), F.count("*").alias("n_copies"))
    kept = whole.join(prefixes, "prefix", "left_anti").select(mark("conv_id").alias("key"), "conv_id", "n_turns", "n_copies")

    said = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"].cast("string"), F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    told = rows.join(kept.select("key"), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rendered = told.select("key", F.array_join(F.transform("turns", said), "").alias("text"))
    return kept.join(rendered, "key").select("conv_id", "n_turns", "n_copies", "text")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(coalesce('+' || role, '-') || chr(30) || coalesce('+' || text, '-'), chr(31)) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
whole AS (SELECT prefix, min(conv_id) AS conv_id, max(k) AS n_turns, count(*) AS n_copies FROM t WHERE k = n GROUP BY prefix),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k < t.n AND t.prefix = w.prefix)),
rendered AS (
  SELECT conv_id, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
  FROM t GROUP BY conv_id)
SELECT kept.conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, rendered.text
FROM kept JOIN rendered ON kept.conv_id IS NOT DISTINCT FROM rendered.conv_id
"""
