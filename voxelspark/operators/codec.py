"""The brick codec: majority pyramid, predicted operations, palette, nibbles and rANS, and decoding to any level.

Bricks meet their voxels in one shuffle; all else is narrow, but for the counts of 16 symbols. The kernels take all bricks of a batch together, level by level, in pieces of about a million voxels, or one brick if that has more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import AXIS, nibbles
from .order import ranked

# Operation codes, and the entropy coder's limits.
PARENT, X, Y, Z, ADVANCE, LAST, BACK = range(7)
LIMIT, BITS = 1 << 23, 12
TOTAL = 1 << BITS
REACH = 15
# The masks that leave one bit of three after shifts by 32, 16, 8, 4 and 2.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def pyramid(finest: np.ndarray, levels: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Labels and constant flags by level, coarsest first, of labels in Morton order: of one brick, or of several one after the other, of ``levels`` levels above the finest."""
    labels, const = [finest], [np.ones(len(finest), bool)]
    while len(labels[0]) > 1 if levels is None else len(labels) <= levels:
        eight = labels[0].reshape(-1, 8)
        alike = (eight == eight[:, :1]).all(1)
        most = eight[:, 0].copy()
        mixed = np.flatnonzero(~alike)
        some = eight[mixed]
        votes = (some[:, :, None] == some[:, None, :]).sum(2)
        most[mixed] = np.where(votes == votes.max(1, keepdims=True), some, np.iinfo(np.int64).max).min(1)
        labels.insert(0, most)
        const.insert(0, alike & const[0].reshape(-1, 8).all(1))
    return labels, const


def spread(v: np.ndarray) -> np.ndarray:
    v = v & AXIS
    for shift, mask in SPREAD:
        v = (v | v << shift) & mask
    return v


def compact(m: np.ndarray) -> np.ndarray:
    m = m & SPREAD[-1][1]
    for (shift, _), mask in zip(reversed(SPREAD), (*(k for _, k in reversed(SPREAD[:-1])), AXIS), strict=True):
        m = (m ^ m >> shift) & mask
    return m


def neighbours(m: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By axis: whether the neighbour out of the block is inside the brick, whether it is later, and its code (one level up if later)."""
    at, out = [compact(m >> i) for i in range(3)], []
    wide = [spread(a) << i for i, a in enumerate(at)]
    for i in range(3):
        later = (at[i] & 1) == 1
        moved = at[i] + np.where(later, 1, -1)
        inside = (moved >= 0) & (moved < 1 << level)
        code = spread(np.where(inside, moved, 0)) << i | wide[i - 1] | wide[i - 2]
        out.append((inside, later, np.where(later, code >> 3, code)))
    return out


def visited(labels: list[np.ndarray], const: list[np.ndarray]):
    """By level from 1 on, the nodes whose parents are not constant, of all bricks of a pyramid: brick, code, operation (ADVANCE where no predictor gives the label), sign of the neighbour's step, stop and label."""
    for level in range(1, len(labels)):
        at = np.flatnonzero(~np.repeat(const[level - 1], 8))
        brick, m = at >> 3 * level, at & (1 << 3 * level) - 1
        here = labels[level][at]
        op, sign = np.full(len(at), ADVANCE), np.zeros(len(at), np.int32)
        for code, (inside, later, to) in reversed(list(zip((X, Y, Z), neighbours(m, level), strict=True))):
            side = np.where(later, labels[level - 1][np.where(later, (brick << 3 * (level - 1)) + to, 0)], labels[level][np.where(later, 0, (brick << 3 * level) + to)])
            hit = inside & (side == here)
            op[hit], sign[hit] = code, np.where(later, 1, -1)[hit]
        hit = labels[level - 1][at >> 3] == here
        op[hit], sign[hit] = PARENT, 0
        yield level, brick, m, op, sign, const[level][at], here


def streams(labels: list[np.ndarray], const: list[np.ndarray]):
    """For each brick of a pyramid its palette and the arrays of its stream: operation, stop and delta. Only labels that all predictors miss go through the palette one by one."""
    levels = list(visited(labels, const))
    brick, op, stop, here = (np.concatenate([np.arange(len(labels[0])) if k == 1 else np.full(len(labels[0]), ADVANCE) if k == 3 else const[0] if k == 5 else labels[0], *(v[k] for v in levels)]) for k in (1, 3, 5, 6))
    order = np.argsort(brick, kind="stable")
    edges = np.searchsorted(brick[order], np.arange(len(labels[0]) + 1))
    for a, b in zip(edges, edges[1:], strict=False):
        at = order[a:b]
        ops, label, delta = op[at], here[at], np.zeros(b - a, np.int64)
        palette = [int(label[0])]
        misses = np.flatnonzero(ops == ADVANCE)[1:]
        for k, value in zip(misses.tolist(), label[misses].tolist(), strict=True):
            recent = palette[: -REACH - 3 : -1]
            if value in recent:
                back = recent.index(value)
                ops[k], delta[k] = (LAST, 0) if back == 0 else (BACK, back - 1)
            else:
                palette.append(value)
        yield palette, ops, stop[at], delta


def operations(labels: list[np.ndarray], const: list[np.ndarray]) -> tuple[list[tuple[int, bool, int]], list[int]]:
    """The stream of (operation, stop, delta) of one brick, and its palette."""
    ((palette, *stream),) = streams(labels, const)
    return [(int(o), bool(s), int(d)) for o, s, d in zip(*stream, strict=True)], palette


def pack(op: np.ndarray, stop: np.ndarray, delta: np.ndarray) -> tuple[bytes, int]:
    """Half bytes, high one first, and their number without the pad."""
    back = op == BACK
    n = len(op) + int(back.sum())
    half = np.zeros(n + n % 2, np.uint8)
    at = np.arange(len(op)) + np.cumsum(back) - back
    half[at] = op * 2 + stop
    half[at[back] + 1] = delta[back]
    return (half[::2] << 4 | half[1::2]).tobytes(), n


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.stack([raw >> 4, raw & 15], 1).reshape(-1)


def encode_bricks(finest: np.ndarray) -> list[tuple[list[int], bytes, int]]:
    """Palette, half bytes and their number for each row of labels."""
    n, voxels = finest.shape
    return [(palette, *pack(*stream)) for palette, *stream in streams(*pyramid(finest.reshape(-1), (voxels.bit_length() - 1) // 3))]


def normalized(counts: list[int]) -> list[int]:
    """Frequencies of 16 symbols that sum to 4096, none 0: what is missing goes to symbol 0, what is over is taken one by one from the largest."""
    counts = [max(1, c) for c in counts]
    total = sum(counts)
    freq = [max(1, c * TOTAL // total) for c in counts]
    freq[0] += max(0, TOTAL - sum(freq))
    while sum(freq) > TOTAL:
        freq[freq.index(max(freq))] -= 1
    return freq


def rans_encode(data: bytes, freq: list[int]) -> bytes:
    cum = np.concatenate([[0], np.cumsum(freq)]).tolist()
    state, out = LIMIT, bytearray()
    for s in unpack(data)[::-1].tolist():
        f = freq[s]
        while state >= (LIMIT >> BITS << 8) * f:
            out.append(state & 255)
            state >>= 8
        state = (state // f << BITS) + state % f + cum[s]
    return bytes(out) + state.to_bytes(4, "little")


def rans_decode(coded: bytes, n_symbols: int, freq: list[int]) -> bytes:
    """The packed half bytes of a coded stream; ValueError if it ends early."""
    symbol = np.repeat(np.arange(16), freq).tolist()
    cum = np.concatenate([[0], np.cumsum(freq)]).tolist()
    if len(coded) < 4:
        raise ValueError("truncated stream")
    state, at, out = int.from_bytes(coded[-4:], "little"), len(coded) - 5, []
    for _ in range(n_symbols + n_symbols % 2):
        slot = state & (TOTAL - 1)
        s = symbol[slot]
        out.append(s)
        state = freq[s] * (state >> BITS) + slot - cum[s]
        while state < LIMIT:
            if at < 0:
                if state == LIMIT or len(out) >= n_symbols + n_symbols % 2:
                    break
                raise ValueError("truncated stream")
            state = state << 8 | coded[at]
            at -= 1
    return bytes(a << 4 | b for a, b in zip(out[::2], out[1::2], strict=True))


def decode_brick(palette: list[int], data: bytes, size: int, lod: int | None = None) -> np.ndarray:
    """Labels in Morton order at level ``lod`` (the finest by default). The root's stop bit counts, so constant bricks decode; a filled mask, not a reserved label, says what is known.

    A level at a time: which half bytes are operations follows from their runs, and a chain of nodes that take their earlier neighbours' labels is followed in steps of twice the length.
    """
    lod = size.bit_length() - 1 if lod is None else lod
    colours = np.array(palette, np.int64)
    half = unpack(data).astype(np.int64)
    maybe = half >> 1 == BACK
    places = np.arange(len(half))
    run = np.maximum.accumulate(np.where(maybe, -1, places))
    is_back = maybe & ((places - run) % 2 == 1)  # in a run of such half bytes operations and deltas alternate
    is_op = ~np.append(False, is_back[:-1])
    starts = np.flatnonzero(is_op)
    op, stop = half[starts] >> 1, (half[starts] & 1).astype(bool)
    back = np.where(op == BACK, half[np.minimum(starts + 1, len(half) - 1)] + 1, 0)
    entry = np.cumsum(op == ADVANCE) - 1 - back
    labels, const, at = colours[:1], stop[:1], 1
    for level in range(1, lod + 1):
        below, fixed = np.repeat(labels, 8), np.repeat(const, 8)
        m = np.flatnonzero(~fixed)
        if at + len(m) > len(op) or (len(m) and starts[at + len(m) - 1] + (op[at + len(m) - 1] == BACK) >= len(half)):
            raise ValueError("the stream ends early")
        ops, chosen = op[at : at + len(m)], entry[at : at + len(m)]
        own = ops >= ADVANCE
        if len(m) and ((chosen[own] < 0) | (chosen[own] >= len(colours))).any():
            raise ValueError("outside the palette")
        below[m[own]] = colours[chosen[own]]
        source = np.arange(len(below))
        for code, (_, later, to) in zip((X, Y, Z), neighbours(m, level), strict=True):
            mine = ops == code
            below[m[mine & later]] = labels[to[mine & later]]
            source[m[mine & ~later]] = to[mine & ~later]
        while (source[source] != source).any():
            source = source[source]
        below = below[source]
        fixed[m] = stop[at : at + len(m)]
        labels, const, at = below, fixed, at + len(m)
    return labels


def brick_rows(bricks: DataFrame) -> DataFrame:
    """A row for each brick of ``bricks`` (brick_id, m, label): brick_id and its voxels, met in one shuffle."""
    return bricks.groupBy("brick_id").agg(F.collect_list(F.struct(F.col("m").cast("long").alias("m"), F.col("label").cast("long").alias("label"))).alias("voxels"))


def dense(batches, size: int, most: int = 1 << 20):
    """Arrow batches of ``brick_rows`` as brick ids and a row of labels each, absent voxels 0; pieces of about ``most`` voxels."""
    for batch in batches:
        for start in range(0, batch.num_rows, max(1, most // size**3)):
            part = batch.slice(start, max(1, most // size**3))
            voxels = part.column("voxels")
            count = voxels.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = voxels.flatten()
            out = np.zeros((part.num_rows, size**3), np.int64)
            m = flat.field("m").to_numpy(zero_copy_only=False)
            if len(m) and not 0 <= m.min() <= m.max() < size**3:
                raise ValueError("voxels outside their bricks")
            out[np.repeat(np.arange(part.num_rows), count), m] = flat.field("label").to_numpy(zero_copy_only=False)
            yield part.column("brick_id").to_numpy(zero_copy_only=False), out


def encode(bricks: DataFrame, size: int, observed: Observation | None = None) -> DataFrame:
    """brick_id, palette, packed (half bytes), n_symbols of each brick of ``bricks`` (brick_id, m, label); absent voxels are 0. ``observed`` gets the numbers of bricks and of half bytes as they pass."""

    def run(batches):
        for ids, finest in dense(batches, size):
            palettes, packed, n = zip(*encode_bricks(finest), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(palettes, pa.list_(pa.int64())), pa.array(packed, pa.binary()), pa.array(n, pa.int32())], names=["brick_id", "palette", "packed", "n_symbols"])

    out = brick_rows(bricks).mapInArrow(run, "brick_id long, palette array<long>, packed binary, n_symbols int")
    return out.observe(observed, F.count("*").alias("bricks"), F.sum("n_symbols").alias("n_symbols")) if observed else out


def symbol_counts(encoded: DataFrame, step: int = 1) -> DataFrame:
    """nibble and n for all 16 symbols, pads counted, of every ``step``-th brick in order of brick_id."""
    some = encoded
    if step > 1:
        some = encoded.join(ranked(encoded.select("brick_id"), "brick_id", "_place").filter(F.col("_place") % step == 0), "brick_id", "left_semi")
    seen = some.select(F.explode(nibbles(F.col("packed"))).alias("nibble")).groupBy("nibble").agg(F.count("*").alias("n"))
    return encoded.sparkSession.range(16).select(F.col("id").cast("int").alias("nibble")).join(seen, "nibble", "left").select("nibble", F.coalesce("n", F.lit(0)).alias("n"))


def rans_model(encoded: DataFrame, step: int = 1) -> list[int]:
    """Frequencies from the counts of all bricks; 16 rows go to the driver."""
    counts = {r["nibble"]: r["n"] for r in symbol_counts(encoded, step).collect()}
    return normalized([counts[i] for i in range(16)])


#: Streams that are coded side by side, a symbol of each at a time; fewer are coded one after the other.
SIDE = 64


def rans_encode_all(streams: list[bytes], freq: list[int]) -> list[bytes]:
    """``rans_encode`` of many streams, in step."""
    if len(streams) < SIDE:
        return [rans_encode(s, freq) for s in streams]
    freq_, cum = np.array(freq, np.int64), np.append(0, np.cumsum(freq))
    order = np.argsort([-len(s) for s in streams], kind="stable")
    sizes = np.array([2 * len(streams[i]) for i in order])
    halves = np.zeros((len(streams), sizes[0]), np.int64)
    for k, i in enumerate(order):
        halves[k, : sizes[k]] = unpack(streams[i])[::-1]
    state, used = np.full(len(streams), LIMIT, np.int64), np.zeros(len(streams), np.int64)
    out = np.zeros((len(streams), 2 * sizes[0] + 8), np.uint8)  # a symbol gives two bytes at most
    active = len(streams)
    for step in range(sizes[0]):
        while active and sizes[active - 1] <= step:
            active -= 1
        s, now = halves[:active, step], state[:active]
        f = freq_[s]
        while (full := np.flatnonzero(now >= (LIMIT >> BITS << 8) * f)).size:
            out[full, used[full]] = now[full] & 255
            used[full] += 1
            now[full] >>= 8
        state[:active] = (now // f << BITS) + now % f + cum[s]
    coded: list[bytes] = [b""] * len(streams)
    for k, i in enumerate(order):
        coded[i] = out[k, : used[k]].tobytes() + int(state[k]).to_bytes(4, "little")
    return coded


def rans_decode_all(coded: list[bytes], counts: list[int], freq: list[int]) -> list[bytes]:
    """``rans_decode`` of many streams, in step."""
    if len(coded) < SIDE:
        return [rans_decode(c, n, freq) for c, n in zip(coded, counts, strict=True)]
    if min(map(len, coded)) < 4:
        raise ValueError("truncated stream")
    symbol, freq_, cum = np.repeat(np.arange(16), freq), np.array(freq, np.int64), np.append(0, np.cumsum(freq))
    order = np.argsort([-n for n in counts], kind="stable")
    sizes = np.array([counts[i] + counts[i] % 2 for i in order])
    data = np.frombuffer(b"".join(coded[i][:-4] for i in order) + b"\0", np.uint8).astype(np.int64)
    ends = np.cumsum([len(coded[i]) - 4 for i in order])
    begin, at = np.append(0, ends[:-1]), ends - 1
    state = np.array([int.from_bytes(coded[i][-4:], "little") for i in order], np.int64)
    out, active = np.zeros((len(coded), sizes[0]), np.uint8), len(coded)
    for step in range(sizes[0]):
        while active and sizes[active - 1] <= step:
            active -= 1
        now = state[:active]
        slot = now & (TOTAL - 1)
        s = symbol[slot]
        out[:active, step] = s
        now = freq_[s] * (now >> BITS) + slot - cum[s]
        while (low := np.flatnonzero(now < LIMIT)).size:
            dry = at[low] < begin[low]
            if (dry & (step + 1 < sizes[:active][low])).any():
                raise ValueError("truncated stream")
            low = low[~dry]
            if not low.size:
                break
            now[low] = now[low] << 8 | data[at[low]]
            at[low] -= 1
        state[:active] = now
    decoded: list[bytes] = [b""] * len(coded)
    for k, i in enumerate(order):
        half = out[k, : sizes[k]]
        decoded[i] = (half[::2] << 4 | half[1::2]).tobytes()
    return decoded


def compress(encoded: DataFrame, freq: list[int]) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"brick_id": pdf["brick_id"], "palette": pdf["palette"], "encoded": rans_encode_all([bytes(p) for p in pdf["packed"]], freq), "n_symbols": pdf["n_symbols"]})

    return encoded.mapInPandas(run, "brick_id long, palette array<long>, encoded binary, n_symbols int")


def decompress(compressed: DataFrame, freq: list[int]) -> DataFrame:
    def run(frames):
        for pdf in frames:
            packed = rans_decode_all([bytes(e) for e in pdf["encoded"]], pdf["n_symbols"].tolist(), freq)
            yield pd.DataFrame({"brick_id": pdf["brick_id"], "palette": pdf["palette"], "packed": packed, "n_symbols": pdf["n_symbols"]})

    return compressed.mapInPandas(run, "brick_id long, palette array<long>, packed binary, n_symbols int")


def decode(encoded: DataFrame, size: int, lod: int | None = None, bricks: int | None = None) -> DataFrame:
    """brick_id, m and label at level ``lod``; bricks travel as one array each and unfold in the JVM. Level 0 is the first label of the palette, without decoding. With ``bricks``, a brick_id that is not below that number raises an error."""
    if bricks is not None:
        known = (F.col("brick_id") >= 0) & (F.col("brick_id") < bricks)
        encoded = encoded.withColumn("brick_id", F.when(known, F.col("brick_id")).otherwise(F.raise_error(F.concat(F.lit("no such brick: "), F.col("brick_id").cast("string")))))
    if lod == 0:
        return encoded.select("brick_id", F.lit(0).cast("long").alias("m"), F.get("palette", F.lit(0)).alias("label"))

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("palette", "packed"))
            for k, (palette, packed) in enumerate(zip(*columns, strict=True)):
                labels = decode_brick(palette, packed, size, lod)
                yield pa.RecordBatch.from_arrays([batch.column("brick_id").slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), pa.array(labels))], names=["brick_id", "labels"])

    arrays = encoded.select("brick_id", "palette", "packed").mapInArrow(run, "brick_id long, labels array<long>")
    return arrays.select("brick_id", F.posexplode("labels").alias("m", "label")).withColumn("m", F.col("m").cast("long"))
