"""Document fingerprints by spot signatures.

Each common word of a text is an anchor; it and the content words that follow it, common words left out, are a signature. The set of a text's signatures is its fingerprint: the common words stand all through prose and hardly in menus and tables, so sets agree where the prose does. Sets are compared by Jaccard similarity, pruned by their lengths: two sets can be as alike as wanted only if the shorter has that share of the longer's length.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, parts, slices, table
from .minhash import BLOCK, cells, components, within
from .quality import Ranges, mixed, spans

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or that the they this to was were which with you",
    "au aux avec ce dans de des du elle en est et il la le les leur mais ne nous ou par pas pour que qui sa se son sur un une",
    "als auf aus bei das dem den der des die ein eine einer er es für im ist mit nicht noch sich sie sind und von war wie zu",
    "al como con del el era es esta ha la las lo los más no o para pero por que se sin su sus también un una y",
)
#: Content words of a signature, each so many content words after the one before.
CHAIN, DISTANCE = 3, 1
#: One other word in so many, by its hash, is an anchor as well, for texts in languages without a list.
SPARSE = 16
SIMILARITY = 0.8
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return Ranges(data).hash(np.concatenate([[0], ends[:-1]]), ends)


COMMON = np.unique(_hashes(sorted({w for line in ANCHORS for w in line.split()})))


def spot_sets(texts: list[str], chain: int = CHAIN, distance: int = DISTANCE, common: np.ndarray = COMMON, sparse: int = SPARSE) -> list[np.ndarray]:
    """The set of signatures of each text, as sorted 32-bit hashes.

    Words are runs of letters and digits, in lower case. A text without any signature has one: the hash of all its words, and of the text itself if it has none. So a set is never empty, and equal texts have equal sets.
    """
    lowered = [t.lower().encode("utf-8", "replace") for t in texts]
    data, n = np.frombuffer(b"".join(lowered), np.uint8), len(texts)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    starts, ends, doc = spans(_WORD[data], offsets)
    ranges = Ranges(data)
    words = ranges.hash(starts, ends)
    listed = common[np.minimum(np.searchsorted(common, words), len(common) - 1)] == words if len(common) else np.zeros(len(words), bool)
    content = np.flatnonzero(~listed)
    anchors = np.flatnonzero(listed | (words % np.uint64(sparse) == 0)) if sparse else np.flatnonzero(listed)
    first = np.searchsorted(content, anchors, "right")
    last = first + (chain - 1) * distance
    here = last < len(content)
    anchors, first, last = anchors[here], first[here], last[here]
    here = doc[content[last]] == doc[anchors] if len(anchors) else np.zeros(0, bool)
    anchors, first = anchors[here], first[here]
    rolled = mixed(words[anchors])
    for j in range(chain):
        rolled = mixed(rolled * _C[0] + words[content[first + j * distance]] + _C[1])
    key = (doc[anchors].astype(np.uint64) << np.uint64(32)) | (rolled >> np.uint64(32))
    bare = np.flatnonzero(np.bincount(doc[anchors], minlength=n) == 0)
    order = within(np.bincount(doc, minlength=n)).astype(np.uint64)
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, doc, mixed(words + order * _C[2]))
    raw = ranges.hash(offsets[:-1], offsets[1:])
    whole = mixed(np.where(np.bincount(doc, minlength=n) > 0, whole, raw * _C[3]) ^ _C[4])
    key = np.unique(np.concatenate([key, (bare.astype(np.uint64) << np.uint64(32)) | (whole[bare] >> np.uint64(32))]))
    cuts = np.searchsorted(key, np.arange(1, n, dtype=np.uint64) << np.uint64(32))
    return np.split((key & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts) if n else []


def spelled(signatures: np.ndarray) -> str:
    """A fingerprint: the number of signatures, and these as 32-bit little-endian numbers in base 64."""
    return f"{len(signatures)}:{base64.b64encode(signatures.astype('<u4').tobytes()).decode()}"


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.split(":")[1]), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sets (sorted); 0 without a look at them where their lengths say that it is below ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def length_class(n: int, similarity: float = SIMILARITY) -> int:
    """The partition of a set of n signatures: sets as alike as ``similarity`` are of the same one or of neighbours."""
    return math.floor(math.log(n) / -math.log(similarity) + 1e-9)


def _judged(ids: list, texts: list[str], nexts: list[str]) -> list[tuple]:
    """A row for each text with the next one: its fingerprint, that of its edited text, and their likenesses."""
    edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, nexts, strict=True)]
    sets = spot_sets([*texts, *edited, *nexts])
    n, out = len(texts), []
    for i, (own, other, after) in enumerate(zip(sets[:n], sets[n : 2 * n], sets[2 * n :], strict=True)):
        sha = hashlib.sha256(edited[i].encode("utf-8", "replace")).hexdigest()
        out.append((ids[i], len(texts[i]), sha, spelled(own), spelled(other), likeness(own, other), likeness(own, after), length_class(len(own))))
    return out


DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_class int"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
_NAMES = [c.split()[0] for c in DDL.split(", ")]

def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole ranges in order, each judged with the one after it. The last row of a range is the text that follows it, and is not told itself."""
    held: list[tuple] = []
    for batch in slices(batches, rows=2048, size=2 << 20):
        rows = held + list(zip(batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], batch.column("last").to_pylist(), strict=True))
        held = rows[-1:]
        at = [i for i, r in enumerate(rows[:-1]) if not r[2]]
        if at:
            told = _judged([rows[i][0] for i in at], [rows[i][1] for i in at], [rows[i + 1][1] for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told), _KINDS, strict=True)], names=_NAMES)


def ranges(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, x) with ``at``, their range by ascending (doc_id, x), nulls first. About n ranges, by approximate percentiles of doc_id; an id that takes several is dealt by the hash x. The bounds, n numbers, are fixed here, so every use has the same ranges."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = F.lit(rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)], F.lit(10 * n)).alias("b")).first()["b"] or [0])
    equal = F.size(F.filter(bounds, lambda b: b == key))
    within_id = F.least(equal, F.floor(F.col("x") / float(1 << 63) * (equal + 1)))
    return rows.withColumn("at", (F.size(F.filter(bounds, lambda b: b < key)) + within_id).cast("int"))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next and length_class of each row.

    The next row is that of the next smaller doc_id, nulls last, then of the next smaller hash of the text, and the first one after the last. The edited text has its last third of code points replaced by the first ones of the next text. Null and empty texts are alike and have the fingerprint of the empty text; rows alike in id and text are each other's next in any order; one row alone is its own next; an empty table gives an empty result; other columns are left out. A text is one task's work, with about 60 bytes of memory for each of its bytes; rows alike in id and text pass through one task, which holds two of them.

    Texts are shuffled once, into ranges of the order. The first row of each range is found beforehand, a row a range, and goes to the range before as the text that follows its last row.
    """
    x = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1)
    rows = ranges(docs.select(F.col(doc_id).cast("long").alias("doc_id"), x.alias("x"), F.col(text).alias("text")), 4 * parts(docs.sparkSession))
    first = rows.groupBy("at").agg(F.max(F.struct("doc_id", "x")).alias("f"))
    order = W.orderBy(F.desc("at"))
    before = first.select("f", F.coalesce(F.lag("at").over(order), F.min("at").over(W.partitionBy())).alias("before"))
    before = checkpoint(before.select("before", F.col("f.doc_id").alias("_id"), F.col("f.x").alias("_x")))
    heads = rows.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("x") == F.col("_x"))).dropDuplicates(["before"])
    heads = heads.select(F.col("before").alias("at"), F.lit(True).alias("last"), "doc_id", "x", "text")
    dealt = rows.select("at", F.lit(False).alias("last"), "doc_id", "x", "text").unionAll(heads)
    ordered = dealt.repartition("at").sortWithinPartitions("at", "last", F.desc_nulls_last("doc_id"), F.desc("x"))
    return ordered.select("doc_id", "text", "last").mapInArrow(_walk, DDL)


def signature_sets(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, node (a hash of the set) and the signatures of each row."""

    def run(batches):
        for batch in slices(batches, size=2 << 20):
            sets = spot_sets([t or "" for t in batch.column("text").to_pylist()])
            nodes = [np.add.reduce(mixed(s.astype(np.uint64) * _C[0] + _C[3])) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(mixed(np.array(nodes, np.uint64)).view(np.int64)), pa.array([s.view(np.int32) for s in sets], pa.list_(pa.int32()))], names=["doc_id", "node", "signatures"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, node long, signatures array<int>")


def _alike(similarity: float):
    def run(cell: pa.Table) -> pa.Table:
        """Links of one cell: its members are of two blocks of a bucket, so at most 2 * BLOCK sets are held."""
        label, block, node = (cell.column(c).to_numpy() for c in ("label", "block", "node"))
        lo, hi = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()
        sets, out = [np.sort(np.array(s, np.int32)) for s in cell.column("signatures").to_pylist()], []
        order = np.argsort([len(s) for s in sets], kind="stable")
        for at, i in enumerate(order):
            for j in order[at + 1 :]:
                if len(sets[i]) < similarity * len(sets[j]):
                    break
                if label[i] != label[j] and (lo == hi or block[i] != block[j]) and likeness(sets[i], sets[j], similarity) >= similarity:
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id (the least doc_id of its class, nulls first) and n_links, the links found between its set and others.

    Equal sets are one node. Two sets as alike as ``similarity`` are of neighbouring length classes and share a signature among the first n - ceil(similarity n) + 1 of each, rarest first; these are the buckets, by length class. Each member of a bucket is compared with its leader, and members that are then of different classes meet in blocks, so no pair is lost and none is made but in blocks. Nulls, repeated rows and empty tables are as in ``fingerprints``.
    """
    of = checkpoint(signature_sets(docs, text, doc_id))
    nodes = checkpoint(of.groupBy("node").agg(F.min("signatures").alias("signatures")))
    n = F.size("signatures")
    each = nodes.select("node", n.alias("n"), F.explode("signatures").alias("s"))
    rare = each.join(each.groupBy("s").agg(F.count("*").alias("f")), "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("r"))
    kept = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    place = F.floor(F.log("n") / -math.log(similarity) + 1e-9).cast("int")
    keys = rare.select("node", F.explode(F.slice("r.s", F.lit(1), kept)).alias("s"), F.explode(F.array(place, place + 1)).alias("c")).select("node", F.xxhash64("s", "c").alias("key"))
    leaders = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("l")).filter("m > 1").select("key", F.col("l").bitwiseXOR(F.col("key")).alias("leader"))
    found = checkpoint(keys.join(leaders, "key").filter("node <> leader").select("key", "node", "leader", F.lit(True).alias("single")))
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("signatures").alias(f"s{c}"))
    pairs = found.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    both, common = pairs.join(side("a"), "a").join(side("b"), "b"), F.size(F.array_intersect("sa", "sb"))
    long_enough = F.least(F.size("sa"), F.size("sb")) >= similarity * F.greatest(F.size("sa"), F.size("sb"))
    held = checkpoint(both.filter(long_enough).filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    # The leader is a member of its bucket's blocks too.
    members = found.select("key", "node", "single").union(found.select("key", "leader", "single").distinct())
    placed = cells(members, components(held), BLOCK).join(nodes, "node")
    more = placed.groupBy("key", "lo", "hi").applyInArrow(_alike(similarity), "a long, b long")
    links = checkpoint(held.union(more).distinct())
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = of.groupBy("node").agg(F.min("doc_id").alias("least")).join(components(links), "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = known.groupBy("label").agg(F.min("least").alias("class_id"))
    told = known.join(classes, "label").select("node", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return of.select("doc_id", "node").join(told, "node").select("doc_id", "class_id", "n_links")


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
