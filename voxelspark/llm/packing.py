"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Pieces of one length are alike to best-fit decreasing, so it runs on the driver over the counts of pieces by length (at most 2048 rows), over runs of like bins instead of single ones. A segment tree over remaining capacities finds the tightest open bins. Each placement says which ranks of a length go to which bins; a piece's rank among those of its length, found by distributed prefix sums, then finds its bin and place by binary search.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, prefix_sums, shielded, slices, table, unshielded

SEQUENCE = 2048
END = 0
#: Pieces in a bucket of a length's order, on average.
BUCKET = 256


class CapacityTree:
    """A segment tree over capacities 0 to ``size``, each with a count of open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has open bins."""
        i = least + self.leaves
        if i >= 2 * self.leaves:
            return None
        while not self.open[i]:
            while i & 1:  # no capacity to the right under this parent
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first rank, pieces a bin, first bin, place in the bin) in order of length and rank, and the number of bins.

    Piece by piece, from the longest: each goes to an open bin of the least capacity that holds it, or to a new one. A bin just used is the tightest for the next piece of the same length while it holds one more, so like bins are filled a run at a time. A length splits at most two runs, so there are at most about three runs a length.
    """
    tree, runs, out, bins = CapacityTree(size), defaultdict(list), [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, each = size, size // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = capacity // length
                first, n = runs[capacity].pop()
                tree.add(capacity, -n)
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left % each if left // each == full else 0
            out.append((length, rank, each, first, size - capacity))
            put(capacity - each * length, first, full)
            if rest:
                put(capacity - rest * length, first + full, 1)
            used = full + bool(rest)
            put(capacity, first + used, n - used)
            rank += full * each + rest
            left -= full * each + rest
    return out, bins


class Encoder:
    """Ids of a byte-level BPE of a tokenizers file. The faster library gets the file's own vocabulary; texts with special tokens, and files whose ids are not in order of the merges, take the slower one."""

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(file)
        told = json.loads(file)
        model, self.special = told["model"], [t["content"] for t in told.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pre = told.get("pre_tokenizer") or {}
        alike = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges))
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if alike else None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = SEQUENCE, end: int = END) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32. A document is its ids and ``end``; longer ones than ``size`` are cut so that only the first piece may be shorter."""
    with open(tokenizer, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encoder = Encoder(shipped.value)
        for part in slices(batches):
            rows = []
            for i, value in zip(part.column("i").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.array([*encoder.ids(value or ""), end], "<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                rows += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) as i", f"`{text}` as text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``cut`` (doc_id, piece, length, ids_crc32 and any other columns) with sequence_id and offset.

    The ranks of a length are dealt to buckets by hash, as many as the length's count asks for, so that a length that most pieces share is no group of its own.
    """
    cut, old, _ = shielded(cut)
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    placed, _ = best_fit_decreasing(counts, size)
    table_ = np.array(placed, np.int64).reshape(-1, 5)
    keys = table_[:, 0] << 44
    order = np.argsort(keys + table_[:, 1], kind="stable")
    shipped = spark.sparkContext.broadcast((keys[order] + table_[order, 1], table_[order]))
    lengths = spark.createDataFrame([(n, -(-c // BUCKET)) for n, c in counts.items()], "length long, _buckets long")
    dealt = cut.join(F.broadcast(lengths), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_buckets"))).drop("_buckets")
    base = prefix_sums(dealt.select("length", "_bucket", F.lit(1).alias("_one")), ["length"], "_bucket", "_one", "_base")
    within = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_within", F.row_number().over(within) - 1).join(base, ["length", "_bucket"])
    ranked = ranked.select(*cut.columns, (F.col("_base") + F.col("_within")).alias("_rank"))
    names = cut.columns

    def run(batches):
        starts, rows = shipped.value
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = rows[np.searchsorted(starts, (n << 44) + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * n)], names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{c}` {kind}" for c, kind in cut.dtypes)
    return unshielded(ranked.mapInArrow(run, f"{ddl}, sequence_id long, offset long"), old)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", size: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.

    ``tokenizer`` is the path of a tokenizers file; the driver reads it. Null and empty texts are the one id ``end``. Repeated rows are packed as often as they come; null ids stay null; an empty table gives an empty result; other columns are left out.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(checkpoint(pieces(docs, tokenizer, text, doc_id, size, end)), size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
