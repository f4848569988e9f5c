"""Removal of repeated strings with suffix arrays of shards.

A string of ``length`` bytes is owned by its least hashed 96-gram, its anchor, wherever it stands. Runs of strings with one anchor form a block, so every string of a block holds the anchor. A block whose anchor is found once holds no repeated string. Each other anchor has a home, the least text that holds it, or itself where that text's anchors have too many bytes; neighbouring blocks of one home are cut out together, in pieces that begin at anchors chosen by hash, so that copies are cut alike. Pieces go to shards by home; a shard's suffix array is induced, and the permuted common prefixes tell which of its strings repeat. Of equal pieces two stand in the array at most, and as the suffixes of the second would follow those of the first, each right behind its twin, only one is sorted. Equal strings have equal anchors, and so one home, so they meet in one shard.

Several lengths are judged at once: blocks are those of the least length, their bytes reach as far as the greatest one, and a longer string is owned by the block of its beginning.

A home with more bytes than two shards is dealt to several. Each then hands on digests of its different strings, and those that two shards have repeat as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, parts, shielded, slices, stored, table, text_buffer, unshielded
from .quality import Ranges, mixed
from .sais import permuted_common_prefixes, suffix_array

LENGTH = 400
#: Bytes of a passage: less than 50 words of five letters and a space.
PASSAGE = 256
GRAM = 96
#: Bytes of a shard, about, and of the texts that are hashed at a time.
SHARD = 1 << 20
SLICE = 1 << 19
#: Blocks of a piece, on average.
MERGE = 32
#: Rows of a table of keys that is broadcast, at most; larger ones are joined by a shuffle.
SMALL = 200_000
SEPARATOR = 0xFF  # no byte of UTF-8


def blocks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Blocks of all texts of a buffer: anchor hash, document, and first and last start of the block's strings."""
    n, empty = len(data), np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty
    gram = min(gram, length)
    width = length - gram + 1
    grams = Ranges(data).hash(np.arange(n - gram + 1), np.arange(gram, n + 1))
    bits = np.uint64(max(32, int(n).bit_length()))  # the same for all buffers, so that equal strings break ties alike
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(packed) // width)
    square = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    square[: len(packed)] = packed
    square = square.reshape(rows, width)
    ahead = np.minimum.accumulate(square, 1).reshape(-1)
    back = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].reshape(-1)
    count = n - length + 1
    least = np.minimum(back[:count], ahead[width - 1 : width - 1 + count])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = doc[:count] == doc[length - 1 :]
    new = np.ones(count, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:count] != doc[: count - 1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], count) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    base = offsets[doc[first]]
    return grams[anchor[first]].view(np.int64), doc[first].astype(np.int64), first - base, last - base


def find_blocks(texts: DataFrame, length: int) -> DataFrame:
    """Blocks of ``texts`` (t1, t2, text): core (the anchor's hash), t1, t2, first, last."""

    def run(batches):
        for part in slices(batches, size=SLICE):
            core, doc, first, last = blocks(*text_buffer(part.column("text")), length)
            ids = [part.column(c).to_numpy()[doc] for c in ("t1", "t2")]
            yield pa.RecordBatch.from_arrays([pa.array(core), *map(pa.array, ids), pa.array(first), pa.array(last)], names=["core", "t1", "t2", "first", "last"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "core long, t1 long, t2 long, first long, last long")


def cut_blocks(texts: DataFrame, reach: int) -> DataFrame:
    """The bytes of the blocks listed in ``texts`` (t1, t2, text, found), up to ``reach`` from their last starts, neighbours of one home together: home, t1, t2, first, digest (d1, d2) of the bytes and the number of starts, starts, size, bytes."""

    def run(batches):
        for part in slices(batches, rows=256, size=SLICE):
            rows = []
            for t1, t2, text, found in zip(*(part.column(c).to_pylist() for c in ("t1", "t2", "text", "found")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for first, last, core, home in sorted((b["first"], b["last"], b["core"], b["home"]) for b in found):
                    if merged and core % MERGE and merged[-1][2] == home and merged[-1][1] + 1 == first:
                        merged[-1][1] = last
                    else:
                        merged.append([first, last, home])
                for first, last, home in merged:
                    starts, piece = last - first + 1, raw[first : last + reach]
                    digest = np.frombuffer(xxhash.xxh3_128_digest(piece, starts), "<i8")
                    rows.append((home, t1, t2, first, digest[0], digest[1], starts, len(piece), piece))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("home", "t1", "t2", "first", "d1", "d2", "starts", "size")] + [("bytes", pa.binary())])
    return texts.mapInArrow(run, "home long, t1 long, t2 long, first long, d1 long, d2 long, starts long, size long, bytes binary")


class Shard:
    """The strings that begin in the first ``starts`` bytes of some pieces, by the suffix array of all their bytes: piece, place in it, and place in the buffer. Pieces with a copy are ``twice`` in the array, each suffix of the copy next to its twin."""

    def __init__(self, pieces: list[bytes], starts: np.ndarray, twice: np.ndarray):
        sizes = np.array([len(p) for p in pieces])
        self.text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), np.uint8)
        begins = np.cumsum(sizes + 1) - sizes - 1
        self.piece = np.repeat(np.arange(len(pieces)), starts)
        self.place = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        self.at = begins[self.piece] + self.place
        self.left = sizes[self.piece] - self.place
        self.twin = twice[self.piece]
        order = suffix_array(self.text)
        shared = permuted_common_prefixes(self.text, order)[order]
        own = np.zeros(len(self.text), bool)
        own[self.at] = True
        ranks = np.flatnonzero(own[order])
        before = np.minimum.reduceat(shared[: ranks[-1] + 1], np.append(0, ranks[:-1] + 1))
        before[0] = 0
        #: What the string at each place shares with the one before it and the one after it in the array, of those that begin in a piece.
        self.before, self.after = np.zeros((2, len(self.text)), np.int32)
        self.before[order[ranks]] = before
        self.after[order[ranks]] = np.append(before[1:], 0)

    def strings(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each string, whether it has ``length`` bytes, whether it repeats then, and whether it is the first of its kind."""
        whole = self.left >= length
        return whole, whole & (self.twin | (self.before[self.at] >= length) | (self.after[self.at] >= length)), whole & (self.before[self.at] < length)


def runs_of(places: np.ndarray, length: int) -> list[list[int]]:
    """Byte ranges [start, end] covered by strings that start at ``places``, in order."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > length)
    starts, ends = places[np.append(0, breaks + 1)], places[np.append(breaks, len(places) - 1)] + length
    return np.stack([starts, ends], 1).tolist()


def shard_arrays(dealt: DataFrame, lengths: list[int], tasks: int) -> DataFrame:
    """For each piece of ``dealt`` (home, salt, shards, d1, d2, copies, starts, bytes) its repeated ranges by length (three numbers each: length, begin, end), and for homes of several shards the hashes of strings to compare across them, with their lengths and places (-1 for strings known to repeat)."""

    def run(batches):
        rows, size, group = [], 0, None

        def flush():
            starts = np.array([r[6] for r in rows])
            shard = Shard([r[7] for r in rows], starts, np.array([r[5] > 1 for r in rows]))
            edges = np.append(0, np.cumsum(starts))
            found = [[] for _ in rows]
            told = [([], [], []) for _ in rows]
            hashes = Ranges(shard.text) if any(r[2] > 1 for r in rows) else None
            for length in lengths:
                whole, repeats, first = shard.strings(length)
                for k, r in enumerate(rows):
                    a, b = edges[k], edges[k + 1]
                    places = shard.place[a:b][repeats[a:b]]
                    for begin, end in runs_of(places, length):
                        found[k] += (length, begin, end)
                    if r[2] > 1:
                        kinds = np.flatnonzero(first[a:b]) + a
                        at = shard.at[kinds]
                        told[k][0].extend(hashes.hash(at, at + length).view(np.int64).tolist())
                        told[k][1].extend([length] * len(kinds))
                        told[k][2].extend(np.where(repeats[kinds], -1, shard.place[kinds]).tolist())
            out = [(*r[:1], *r[3:5], found[k], *told[k]) for k, r in enumerate(rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("home", "salt", "shards", "d1", "d2", "copies", "starts", "bytes")), strict=True):
                if row[:2] != group and size >= SHARD:
                    yield flush()
                    rows, size = [], 0
                group = row[:2]
                rows.append(row)
                size += len(row[7])
        if rows:
            yield flush()

    schema = pa.schema([(c, pa.int64()) for c in ("home", "d1", "d2")] + [(c, pa.list_(pa.int64())) for c in ("ranges", "strings", "lengths", "places")])
    dealt = dealt.repartition(tasks, "home", "salt").sortWithinPartitions("home", "salt", "d1", "d2")
    return dealt.mapInArrow(run, "home long, d1 long, d2 long, ranges array<long>, strings array<long>, lengths array<long>, places array<long>")


def repeated_ranges(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """t1, t2, length and the byte ranges (a, b) of each text that lie in repeated strings of that length, in no order and overlapping; ``texts`` has t1, t2 and text for each row."""
    found = stored(find_blocks(texts, min(lengths)), "blocks")
    cores = found.groupBy("core").agg(F.count("*").alias("n"), F.min("t1").alias("home"), F.sum(F.col("last") - F.col("first") + 1).alias("b")).filter("n > 1")
    cores = checkpoint(cores.select("core", "home", "b"))
    small = cores.groupBy("home").agg(F.sum("b").alias("b")).filter(F.col("b") <= SHARD // 2).select("home", F.lit(True).alias("small"))
    homes = checkpoint(cores.join(small, "home", "left").select("core", F.when(F.col("small"), F.col("home")).otherwise(F.col("core")).alias("home")))
    listed = checkpoint(found.join(homes, "core").groupBy("t1", "t2").agg(F.collect_set(F.struct("home", "core", "first", "last")).alias("found")))
    keys = listed.select("t1", "t2")
    near = texts.join(F.broadcast(keys), ["t1", "t2"], "left_semi") if listed.count() <= SMALL else texts
    cut = stored(cut_blocks(near.join(listed, ["t1", "t2"]).select("t1", "t2", "text", "found"), max(lengths)), "pieces")

    piece = ["home", "d1", "d2"]
    kinds = checkpoint(cut.groupBy(*piece).agg(F.count("*").alias("copies"), F.max("starts").alias("starts"), F.max("size").alias("size")))
    large = kinds.groupBy("home").agg(F.ceil(F.sum("size") / (2 * SHARD)).alias("shards")).filter("shards > 1")
    # Bytes are dealt by home and digest, as a home may be in most texts; large homes, at most one for the bytes of two shards, are few.
    large = checkpoint(large)
    large = F.broadcast(large) if large.count() <= SMALL else large
    dealt = checkpoint(kinds.join(large, "home", "left").select(*piece, "copies", "starts", "size", F.coalesce("shards", F.lit(1).cast("long")).alias("shards")))
    pieces = cut.groupBy(*piece).agg(F.first("bytes").alias("bytes")).join(dealt, piece)
    tasks = -(-(dealt.agg(F.sum("size")).first()[0] or 0) // (2 * SHARD))  # small next to what a task does with them
    told = checkpoint(shard_arrays(pieces.withColumn("salt", F.pmod("d1", "shards")), lengths, max(parts(texts.sparkSession), tasks)))

    strings = told.filter(F.size("strings") > 0).select(*piece, F.explode(F.arrays_zip("strings", "lengths", "places")).alias("s")).select(*piece, F.col("s.strings").alias("string"), F.col("s.lengths").alias("length"), F.col("s.places").alias("place"))
    twice = strings.groupBy("home", "string").agg(F.count("*").alias("n")).filter("n > 1").select("home", "string")
    across = strings.filter("place >= 0").join(twice, ["home", "string"], "left_semi").select(*piece, "length", F.col("place").alias("a"), (F.col("place") + F.col("length")).alias("b"))
    ranges = told.select(*piece, F.explode(F.expr("transform(sequence(0, size(ranges) div 3), i -> struct(get(ranges, 3 * i) as length, get(ranges, 3 * i + 1) as a, get(ranges, 3 * i + 2) as b))")).alias("r")).select(*piece, "r.*").filter("a is not null")
    placed = cut.select("t1", "t2", "first", *piece).join(ranges.union(across), piece)
    return placed.select("t1", "t2", "length", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def merged(ranges) -> list[list[int]]:
    """Sorted byte ranges (a, b) without overlaps; those that touch are one."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with _n_bytes, _n_removed, _n_spans, _kept_sha256 and _kept, and with ``passage`` also _n_passages and _passage_bytes.

    Texts are UTF-8 bytes, null as none. Bytes covered by a string of ``length`` bytes that starts anywhere else too, in the same text or another, are removed; all strings are judged on the input. _kept is what is left as text; a character that loses some of its bytes only is left out of it, but not of _kept_sha256. _n_passages counts the maximal runs of bytes covered by repeated strings of ``passage`` bytes, and _passage_bytes their bytes; these are told, not removed. Repeated rows are two places, so both lose all strings; texts shorter than ``length`` lose nothing; an empty table gives an empty result. A very long text is hashed by one task in one piece, which takes about 50 bytes of memory for each of its bytes. Other columns are kept, whatever their names; those with the names of the operator's own are replaced. Jobs run while the result is being made.

    Texts meet by 128 bits of their hash, and equal blocks by a 128-bit digest; anchors go by 64 bits, whose collisions only bring strangers to one shard. That strings repeat is read off the suffix arrays, but for strings whose anchors have more bytes than a shard, which meet by 64 bits of their hash below one anchor.
    """
    lengths = sorted({length, passage or length})
    docs, old, (text,) = shielded(docs, text)
    keyed = docs.withColumns({"_t1": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "_t2": F.xxhash64(F.lit(5), F.coalesce(F.col(text), F.lit("")))})
    texts = keyed.filter(F.octet_length(text) >= lengths[0]).select(F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), F.col(text).alias("text"))
    ranges = repeated_ranges(texts, lengths).groupBy(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    ranges = checkpoint(ranges.agg(F.sort_array(F.collect_set(F.array("length", "a", "b"))).alias("_ranges")))
    if ranges.count() <= SMALL:  # only the texts that lose something are dealt anew
        keys = F.broadcast(ranges.select("_t1", "_t2"))
        whole = keyed.join(keys, ["_t1", "_t2"], "left_anti").withColumn("_ranges", F.lit(None).cast("array<array<bigint>>"))
        joined = keyed.join(keys, ["_t1", "_t2"], "left_semi").join(ranges, ["_t1", "_t2"]).unionByName(whole).drop("_t1", "_t2")
    else:
        joined = keyed.join(ranges, ["_t1", "_t2"], "left").drop("_t1", "_t2")
    names = docs.columns
    own = {"_n_bytes": "long", "_n_removed": "long", "_n_spans": "long", "_kept_sha256": "string", "_kept": "string"} | ({"_n_passages": "long", "_passage_bytes": "long"} if passage else {})
    types = [pa.int64() if t == "long" else pa.string() for t in own.values()]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{n} {t}" for n, t in own.items())])

    def run(batches):
        for part in slices(batches, column=text):
            out = []
            for value, found in zip(part.column(text).to_pylist(), part.column("_ranges").to_pylist(), strict=True):
                raw = (value or "").encode("utf-8", "surrogatepass")
                gone = merged(r[1:] for r in found or () if r[0] == length)
                left = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)], strict=True))
                row = (len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if gone else value)
                told = merged(r[1:] for r in found or () if r[0] == passage) if passage else ()
                out.append((*row, len(told), sum(b - a for a, b in told))[: len(own)])
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=[*names, *own])

    return unshielded(joined.mapInArrow(run, kinds), old)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at 400 bytes, and the passages of 256 bytes or more that repeat, which it leaves in the text."""
    told = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
    return told.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")))
