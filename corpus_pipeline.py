"""A pipeline over the documents: language ID, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of the documents, and extra ones with them, whatever their names. An empty table gives an empty result in every stage. Texts are taken whole, however long; where one text is one task's work, the stage says so. Jobs run while a stage is being made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm.common import shielded, stored, unshielded
from voxelspark.llm.langid import fit, predict
from voxelspark.llm.minhash import keep_one
from voxelspark.llm.mixing import take
from voxelspark.llm.packing import pack_documents
from voxelspark.llm.suffix_dedup import PASSAGE, remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; the classifier is fitted on a bounded sample of the labelled ones among them.

    Null and empty texts, and texts without a letter, go. Null labels, sources and ids do not matter. Repeated rows are judged alike, and all stay or go. A text is judged in one task.
    """
    docs, old, _ = shielded(docs)
    named = predict(docs, fit(docs), out=("_lang", "_score", "_rejected"))
    return unshielded(named.filter(~F.col("_rejected")).select(*docs.columns), old)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least doc_id, nulls first, and of the least hash of its text among several.

    Null, empty and white texts are one group. Of rows alike in id and text one stays. A text is hashed in one task.
    """
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 256 bytes that repeat: passages of 50 words of five letters and a space have 300.

    Every place loses them, the first one too. Documents without any keep text and n_chars as they are, null ones too; the others' n_chars is counted anew. Repeated rows repeat all their strings, and lose them. A text is hashed in one task, which takes about 50 bytes of memory for each of its bytes.
    """
    docs, old, _ = shielded(docs)
    left = remove_repeats(docs, length=PASSAGE)
    text = F.when(F.col("_n_spans") > 0, F.col("_kept")).otherwise(F.col("text"))
    counted = F.when(F.col("_n_spans") > 0, F.length("_kept")).otherwise(F.col("n_chars"))
    return unshielded(left.withColumns({"text": text, "n_chars": counted.cast("long")}).select(*docs.columns), old)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: each document as often as the mix takes it, from 0 to 3 times.

    Null sources are one source, null texts have size 0, and null ids come first among their source's. Repeated rows are documents of their own; ties in the order are equal rows.
    """
    return take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    Null and empty texts are one token. Repeated rows, as the mix makes them, are packed as often as they come; null ids stay null. A text is tokenised in one task.
    """
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("packing", packing)]

#: Training and banded hashing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
