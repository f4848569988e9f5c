"""MinHash near-deduplication with DartMinHash signatures.

A document is the multiset of its five-word shingles, weighted by their counts; similarity is the weighted Jaccard of two such multisets. Hashed darts fall on each element's plane of weight and rank, a Poisson number into each of its cells; those below the element's weight are its own, and every coordinate of the signature keeps the one of least rank. Signatures agree in a coordinate with the probability of the similarity. Equal multisets are one node. Nodes that share a band of the signature are compared with one leader of the band's bucket by their exact similarity; members that are then still of different classes are all compared with each other. Classes are the connected components of the links that hold.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, shielded, slices, table, text_buffer, unshielded
from .quality import SPACE, Ranges, mixed, spans

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Members of a bucket that are compared in one piece of work: a block with itself or with another block.
BLOCK = 512
#: Rows of a table of buckets that is broadcast, at most; larger ones are joined by a shuffle.
SMALL = 200_000
#: Arcs of a graph whose components are sought that a task takes, where partitions would hold less.
ARCS = 50_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _poisson() -> np.ndarray:
    """64-bit numbers below which a cell holds at most 0, 1, ... darts of one expected; what lies above the last is less than one in 2^64."""
    with localcontext() as exact:
        exact.prec = 40
        share, total, out = Decimal(-1).exp(), Decimal(0), []
        for n in range(1, 24):
            total += share
            out.append(min(int(total * 2**64), 2**64 - 1))
            share /= n
    return np.array(out, np.uint64)


POISSON = _poisson()


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of ``counts``."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def shingle_counts(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each document, their documents and their counts. A document of fewer words is one shingle of all its words; without words it has none."""
    n = len(offsets) - 1
    starts, ends, doc = spans(~SPACE[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = Ranges(data).hash(starts, ends)
    total = np.bincount(doc, minlength=n)
    first = np.cumsum(total) - total
    length = np.where(total < size, total, size)
    count = np.where(total > 0, np.maximum(total - size + 1, 1), 0)
    of = np.repeat(np.arange(n), count)
    begin = first[of] + within(count)
    rolled = np.zeros(len(begin), np.uint64)
    for j in range(size):
        here = j < length[of]
        rolled[here] += words[begin[here] + j] * _C[j]
    shingles = mixed(rolled)
    order = np.lexsort((shingles, of))
    shingles = shingles[order]
    new = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])])
    at = np.flatnonzero(new)
    return shingles[at], of[at], np.diff(np.append(at, len(new)))


def units_of(shingles: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each occurrence of a shingle, numbered within its document, and their documents: sets of these have the weighted similarity of the multisets."""
    return mixed(np.repeat(shingles, counts) + within(counts).astype(np.uint64) * _C[0]), np.repeat(doc, counts)


def dart_signatures(elements: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """k coordinates for each of n documents of weighted elements (hash, document, weight): the dart of least rank in each, 0 for documents without elements.

    The plane of an element is cut into regions that double: region v holds the weights from 2^v - 1 to 2^(v+1) - 1, in cells as wide as the region and 2^-v high, so each cell has the area 1 and one dart is expected in it. The cells are the same for all documents; an element visits the regions up to its weight, and in each the cells up to the rank that is wanted, so heavy elements cost about their weight times that rank and not their weight. Darts beyond the weight or the rank do not count.

    Darts up to a rank of t / (a document's weight), t = k ln k + 2 k, fill nearly all coordinates; documents that miss one look up to twice that rank, and so on. Lower ranks come first either way, so the bound does not change what a coordinate holds.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n)
    bound = (k * np.log(k) + 2 * k) / np.where(total > 0, total, 1)
    open_ = total > 0
    while open_.any():
        found = []
        for v in range(int(np.log2(weight.max() + 1)) + 1):
            at = np.flatnonzero(open_[doc] & (weight > 2**v - 1))
            cells = np.ceil(bound[doc[at]] * 2**v).astype(np.int64)
            place, row = np.repeat(at, cells), within(cells)
            cell = mixed(elements[place] + row.astype(np.uint64) * _C[1] + np.uint64(v * int(_C[0]) & (1 << 64) - 1))
            darts = np.searchsorted(POISSON, cell, "right")
            which = np.repeat(np.arange(len(cell)), darts)
            dart = mixed(cell[which] + (within(darts).astype(np.uint64) + np.uint64(1)) * _C[2])
            rank = (row[which] + (dart >> np.uint64(11)) * 2.0**-53) * 2.0**-v
            high = 2**v - 1 + (mixed(dart ^ _C[4]) >> np.uint64(11)) * 2.0 ** (v - 53)
            of = doc[place[which]]
            hit = (rank <= bound[of]) & (high < weight[place[which]])
            found.append((mixed(dart[hit] ^ _C[3]), rank[hit], of[hit]))
        dart, rank, of = (np.concatenate(c) for c in zip(*found, strict=True))
        key = of * k + ((dart >> np.uint64(33)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, key))
        key = key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        out.reshape(-1)[key[first]] = dart[order[first]]
        filled = np.bincount(key[first] // k, minlength=n)
        open_ &= filled < k
        bound = np.where(open_, bound * 2, bound)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    rolled = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        rolled = mixed(rolled + parts[:, :, j] * _C[j % 5])
    return mixed(rolled + np.arange(1, bands + 1, dtype=np.uint64) * _C[4])


def signatures(docs: DataFrame, text: str, doc_id: str, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, a hash of the text, the node (a hash of the multiset) and the band hashes (none for documents without words)."""

    def run(batches):
        for part in slices(batches, size=2 << 20):
            elements, of, counts = shingle_counts(*text_buffer(part.column("text")), size)
            units, doc = units_of(elements, of, counts)
            n = part.num_rows
            node = np.zeros(n, np.uint64)
            np.add.at(node, doc, mixed(units ^ _C[4]))
            bare = np.bincount(doc, minlength=n) == 0
            hashes = band_hashes(dart_signatures(elements, of, counts, n, bands * rows), bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(bare, 0, bands))]).astype(np.int32)), pa.array(hashes[~bare].reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("x"), pa.array(mixed(node).view(np.int64)), lists], names=["doc_id", "x", "node", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("x")).mapInArrow(run, "doc_id long, x long, node long, bands array<long>")


def unit_arrays(docs: DataFrame, size: int) -> DataFrame:
    """node and its units as sorted 32-bit hashes, of ``docs`` with doc_id, text and x. Two different units of a pair are taken for one with odds of one in 2^32 each, which moves a similarity by one part of their number."""

    def run(batches):
        for part in slices(batches, size=2 << 20):
            units, doc = units_of(*shingle_counts(*text_buffer(part.column("text")), size))
            n = part.num_rows
            node = np.zeros(n, np.uint64)
            np.add.at(node, doc, mixed(units ^ _C[4]))
            short = (units >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(mixed(node).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(short))], names=["node", "units"])

    return docs.select("text").mapInArrow(run, "node long, units array<int>")


def buckets(nodes: DataFrame) -> DataFrame:
    """key, node, leader and single (whether the bucket is of one band) of all nodes but the leader in each bucket of a band, and of two neighbouring bands together. The leader is the least node of an order of the bucket's own, so the members of a group meet many leaders."""
    pairs_of_bands = F.transform(F.sequence(F.lit(1), F.size("bands")), lambda i: F.xxhash64(F.element_at("bands", i), F.element_at("bands", i % F.size("bands") + 1)))
    keys = nodes.filter(F.size("bands") > 0).select("node", F.size("bands").alias("n_bands"), F.posexplode(F.concat("bands", pairs_of_bands)).alias("pos", "key"))
    leaders = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("m")).filter("n > 1").select("key", F.col("m").bitwiseXOR(F.col("key")).alias("leader"))
    return keys.join(leaders, "key").filter("node <> leader").select("key", "node", "leader", (F.col("pos") < F.col("n_bands")).alias("single"))


def cells(found: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """key, lo, hi, block, node and label: the members of each bucket of one band that holds several classes, dealt into cells, so that every two members of different classes meet in a cell (lo, hi), as members of the blocks lo and hi.

    Members of the bucket's largest class do not meet each other: n members, m of them of other classes, make about n * m / block rows.
    """
    labelled = found.filter("single").select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    several = checkpoint(per.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("m")).filter("m.c < n").select("key", "n", F.col("m.c").alias("most"), F.col("m.label").alias("large")))
    several = F.broadcast(several) if several.count() <= SMALL else several
    whole, large = F.col("n") <= block, F.col("label") == F.col("large")
    n_large = F.when(whole, 0).otherwise(F.ceil(F.col("most") / block)).cast("int")
    n_other = F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / block)).cast("int")
    dealt = labelled.join(several, "key").select("key", "node", "label", (large & ~whole).alias("large"), n_large.alias("nl"), n_other.alias("no"))
    own = F.pmod(F.xxhash64("node", "key"), F.when(F.col("large"), F.col("nl")).otherwise(F.col("no"))).cast("int") + F.when(F.col("large"), F.col("no")).otherwise(0)
    met = F.sequence(F.lit(0), F.when(F.col("large"), F.col("no")).otherwise(F.col("no") + F.col("nl")) - 1)
    met = dealt.withColumn("block", own).select("key", "node", "label", "block", F.explode(met).alias("other"))
    return met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label")


def alike_in_cell(node, label, block, bands, units, sizes, cell: tuple[int, int, int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of one cell whose exact similarity is at least ``similarity``. A pair is compared in the first band it shares only. ``units`` are those of all members one after the other, ``sizes`` their numbers."""
    key, lo, hi = cell
    differ = label[:, None] != label[None, :]
    differ = np.triu(differ) if lo == hi else differ & (block == lo)[:, None] & (block == hi)[None, :]
    differ &= np.minimum(sizes[:, None], sizes[None, :]) >= similarity * np.maximum(sizes[:, None], sizes[None, :])
    if not differ.any():
        return []
    i, j = np.nonzero(differ)
    for column in bands.T:
        here = column == key
        first = here[i] & here[j]
        if first.any():
            i, j = i[first], j[first]
            break
        later = column[i] != column[j]
        i, j = i[later], j[later]
    if not len(i):
        return []
    kinds, code = np.unique(units, return_inverse=True)
    of = np.repeat(np.arange(len(node)), sizes)
    mark, out = np.zeros(len(kinds), bool), []
    pairs = np.unique(of * len(kinds) + code)
    of, code = np.divmod(pairs, len(kinds))
    ends = np.searchsorted(of, np.arange(len(node) + 1))
    for a in np.unique(i):
        own = code[ends[a] : ends[a + 1]]
        mark[own] = True
        common = np.bincount(of, weights=mark[code], minlength=len(node))
        mark[own] = False
        for b in j[i == a]:
            if common[b] >= similarity * (sizes[a] + sizes[b] - common[b]):
                out.append((int(min(node[a], node[b])), int(max(node[a], node[b]))))
    return out


def links_of_cells(placed: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of the cells ``placed`` (key, lo, hi, block, node, label, bands, units), each cell in one piece as its rows come in order."""

    def whole(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if not held.num_rows:
                continue
            place = [held.column(c).to_numpy() for c in ("key", "lo", "hi")]
            starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in place])) + 1
            for a, b in zip([0, *starts[:-1]], starts):
                yield held.slice(a, b - a)
            held = held.slice(starts[-1]) if len(starts) else held
        if held is not None and held.num_rows:
            yield held

    def run(batches):
        out = []
        for part in whole(batches):
            if part.num_rows > 1:
                column = lambda c: part.column(c).combine_chunks()  # noqa: E731, B023
                node, label, block = (column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "block"))
                bands = column("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
                units = column("units")
                sizes = units.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                out += alike_in_cell(node, label, block, bands, units.flatten().to_numpy(zero_copy_only=False), sizes, tuple(part.column(c)[0].as_py() for c in ("key", "lo", "hi")), similarity)
            if len(out) >= 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, similarity: float, size: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes, a < b, whose exact similarity is at least ``similarity``, and the label of each such node's class.

    First, in each bucket, all nodes are compared with its leader, which gives n - 1 candidates for n nodes. Then all pairs of different classes that share a bucket are compared. A pair that shares a bucket and is like each other is so of one class.
    """
    found = checkpoint(buckets(nodes))
    candidates = checkpoint(found.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())

    needed = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node").select(F.col("rep.doc_id").alias("_id"), F.col("rep.x").alias("_x"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("x"))
    texts = texts.join(needed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("x") == F.col("_x")), "left_semi")
    units = checkpoint(unit_arrays(texts, size).groupBy("node").agg(F.min("units").alias("units")))
    both = candidates.join(units.select(F.col("node").alias("a"), F.col("units").alias("ua")), "a").join(units.select(F.col("node").alias("b"), F.col("units").alias("ub")), "b")
    common = F.size(F.array_intersect("ua", "ub"))
    held = checkpoint(both.filter(common >= similarity * (F.size("ua") + F.size("ub") - common)).select("a", "b"))
    labels = components(held)

    placed = checkpoint(cells(found, labels, block))
    own = units.join(placed.select("node").distinct(), "node").join(nodes.select("node", "bands"), "node")
    more = checkpoint(links_of_cells(placed.join(own, "node").select("key", "lo", "hi", "block", "node", "label", "bands", "units"), similarity))
    if more.isEmpty():
        return held, labels
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    joined = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()
    above = components(joined).select(F.col("node").alias("label"), F.col("label").alias("least"))
    known = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return checkpoint(held.union(more)), checkpoint(known.join(above, "label", "left").select("node", F.coalesce("least", "label").alias("label")))


def components(edges: DataFrame) -> DataFrame:
    """node and the least node of its connected component, for all nodes of ``edges`` (a, b): neighbours' least labels and pointer jumping, until nothing changes. Each turn runs several stages, so partitions of few arcs are read together: tasks follow the arcs, not the setting of the shuffles."""
    arcs = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    tasks = max(1, -(-arcs.count() // ARCS))
    together = lambda df: checkpoint(df.coalesce(tasks))
    arcs = arcs.coalesce(tasks)
    labels = together(arcs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = arcs.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        step = together(step)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = together(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, x (a hash of its text), class_id and n_links.

    class_id is the least doc_id of the class, or, where all its ids are null, a hash. n_links counts the links that were found and hold between the document's multiset and others. Null, empty and white texts have no shingles and are one class. Repeated rows are of one class and stay repeated; an empty table gives an empty result; other columns are left out. Nodes are 64-bit hashes; of 10^10 different multisets, three pairs are expected to share one.
    """
    signed = checkpoint(signatures(docs, text, doc_id, bands, rows, size))
    nodes = checkpoint(signed.groupBy("node").agg(F.min(F.struct("doc_id", "x")).alias("rep"), F.min("doc_id").alias("least"), F.min("bands").alias("bands")))
    held, labels = links(docs, nodes, text, doc_id, similarity, size)
    degree = held.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = nodes.select("node", "least").join(labels, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = known.groupBy("label").agg(F.min("least").alias("class_id"))
    of_node = known.join(classes, "label").select("node", F.coalesce("class_id", "label").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return signed.select("doc_id", "x", "node").join(of_node, "node").select("doc_id", "x", "class_id", "n_links")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of ``docs`` for each class: the one of the least doc_id (nulls first), and of the least hash of the text among several. Of rows alike in both, one stays. All columns are kept, whatever their names."""
    docs, old, (text, doc_id) = shielded(docs, text, doc_id)
    classes = near_duplicates(docs, text, doc_id, **options)
    kept = checkpoint(classes.groupBy("class_id").agg(F.min(F.struct("doc_id", "x")).alias("r"), F.count("*").alias("n")).select(F.col("r.doc_id").alias("_id"), F.col("r.x").alias("_x")))
    key = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & F.xxhash64(F.col(text)).eqNullSafe(F.col("_x"))
    repeated = checkpoint(classes.groupBy("doc_id", "x").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("x").alias("_x")))
    once = docs.join(kept, key, "left_semi")
    if repeated.isEmpty():
        return unshielded(once, old)
    alone, several = once.join(repeated, key, "left_anti"), once.join(repeated, key, "left_semi")
    numbered = several.withColumns({"_id": F.col(doc_id), "_x": F.xxhash64(F.col(text))})
    return unshielded(alone.unionByName(numbered.dropDuplicates(["_id", "_x"]).drop("_id", "_x")), old)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
