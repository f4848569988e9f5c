import random
import struct

import numpy as np
import pytest
from pyspark.sql import Observation

from voxelspark.operators import codec


def volumes():
    rng = np.random.default_rng(1)
    grid = np.indices((8, 8, 8)).reshape(3, -1)
    m = codec.spread(grid[0]) | codec.spread(grid[1]) << 1 | codec.spread(grid[2]) << 2
    checker = np.zeros(512, np.int64)
    checker[m] = grid.sum(0) % 2
    near = np.zeros(512, np.int64)
    seeds = rng.integers(0, 8, (20, 3))
    near[m] = ((grid.T[:, None] - seeds) ** 2).sum(2).argmin(1) + 1
    yield from (np.full(512, 7), np.arange(512), checker, near, rng.integers(0, 40, 512), rng.integers(0, 2, 512), np.where(np.arange(512) < 64, -1, np.arange(512) // 8))


def plain_brick(finest, size):
    """Palette, half bytes and their number, node by node, by the rules of the format."""
    labels, const = [[int(v) for v in finest]], [[True] * len(finest)]
    while len(labels[0]) > 1:
        groups = [labels[0][i : i + 8] for i in range(0, len(labels[0]), 8)]
        const.insert(0, [len(set(g)) == 1 and all(const[0][8 * i : 8 * i + 8]) for i, g in enumerate(groups)])
        labels.insert(0, [min(g, key=lambda v: (-g.count(v), v)) for g in groups])
    place = lambda m: [sum((m >> 3 * b + i & 1) << b for b in range(7)) for i in range(3)]
    code = lambda p: sum((c >> b & 1) << 3 * b + i for i, c in enumerate(p) for b in range(7))
    half, palette = [8 + const[0][0]], [labels[0][0]]
    for level in range(1, len(labels)):
        for m, label in enumerate(labels[level]):
            if const[level - 1][m >> 3]:
                continue
            ways = [labels[level - 1][m >> 3]]
            for i in range(3):
                p = place(m)
                p[i] += 1 if p[i] & 1 else -1
                to = code(p) if 0 <= p[i] < 1 << level else None
                ways.append(None if to is None else labels[level][to] if to < m else labels[level - 1][to >> 3])
            back = palette[::-1].index(label) if label in palette else 99
            op = ways.index(label) if label in ways else 5 if back == 0 else 6 if back <= 16 else 4
            half.append(op * 2 + const[level][m])
            if op == 6:
                half.append(back - 1)
            if op == 4:
                palette.append(label)
    padded = half + [0] * (len(half) % 2)
    return palette, bytes(a << 4 | b for a, b in zip(padded[::2], padded[1::2])), len(half)


def plain_rans(data, freq):
    state, out, cum = 1 << 23, [], [sum(freq[:i]) for i in range(16)]
    for s in [n for b in data for n in (b >> 4, b & 15)][::-1]:
        while state >= (1 << 19) * freq[s]:
            out.append(state & 255)
            state >>= 8
        state = state // freq[s] * 4096 + state % freq[s] + cum[s]
    return bytes(out) + bytes(state >> 8 * i & 255 for i in range(4))


def test_bytes_by_hand():
    """A constant brick is one operation: a new palette entry (4) and the stop bit, so 9 and the pad. Freq 256 each: 9 * 256 is added in 4096 steps."""
    assert codec.encode_bricks(np.full((1, 8), 7, np.int64)) == [([7], b"\x90", 1)]
    assert codec.encode_bricks(np.array([[1, 1, 1, 1, 1, 1, 1, 2]])) == [([1, 2], bytes([0x81, 0x11, 0x11, 0x11, 0x90]), 9)]
    assert codec.normalized([0] * 15 + [4081]) == [1] * 15 + [4081]
    assert codec.normalized([9, 1] + [0] * 14) == [1537 + 4096 - 1537 - 15 * 170] + [170] * 15  # 9, and fifteen ones, of 24
    # 2^23 takes in 0 (to 2^27, no byte), then 9: below 2^27 no more, so a byte 0 goes and 2^19 is left, to 2^23 + 9 * 256.
    assert codec.rans_encode(b"\x90", [256] * 16) == b"\0" + struct.pack("<I", (1 << 23) + 9 * 256)


@pytest.mark.parametrize("k", range(7))
def test_round_trip_at_all_levels(k):
    finest = list(volumes())[k].astype(np.int64)
    labels, const = codec.pyramid(finest)
    stream, palette = codec.operations(labels, const)
    ((same, packed, n),) = codec.encode_bricks(finest[None])
    assert (same, packed, n) == plain_brick(finest, 8) and same == palette
    assert len(palette) == sum(o == codec.ADVANCE for o, _, _ in stream)
    assert n == len(stream) + sum(o == codec.BACK for o, _, _ in stream) and len(packed) == (n + 1) // 2
    freq = codec.normalized(np.bincount(codec.unpack(packed), minlength=16).tolist())
    assert sum(freq) == 4096 and min(freq) >= 1
    assert codec.rans_decode(codec.rans_encode(packed, freq), n, freq) == packed
    for lod in range(4):
        assert (codec.decode_brick(palette, packed, 8, lod) == labels[lod]).all()


def test_rans_on_random_streams():
    rng = random.Random(4)
    for _ in range(100):
        data = bytes(rng.choice([rng.randrange(256), 0, 17]) for _ in range(rng.randrange(1, 200)))
        freq = codec.normalized([rng.randrange(5000) * rng.choice([0, 1, 9]) for _ in range(16)])
        assert codec.rans_encode(data, freq) == plain_rans(data, freq)
        assert codec.rans_decode(codec.rans_encode(data, freq), 2 * len(data), freq) == data


def test_streams_side_by_side():
    rng = np.random.default_rng(6)
    data = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in rng.integers(1, 300, codec.SIDE + 9)]
    freq = codec.normalized(rng.integers(0, 3000, 16).tolist())
    coded = codec.rans_encode_all(data, freq)
    assert coded == [plain_rans(d, freq) for d in data]
    counts = [2 * len(d) for d in data]
    assert codec.rans_decode_all(coded, counts, freq) == data
    with pytest.raises(ValueError, match="truncated"):
        codec.rans_decode_all([c[len(c) // 2 :] for c in coded], counts, freq)


def test_broken_streams_are_refused():
    (palette, packed, _), = codec.encode_bricks(np.arange(512)[None])
    with pytest.raises(ValueError, match="ends early"):
        codec.decode_brick(palette, packed[: len(packed) // 2], 8)
    with pytest.raises(ValueError, match="outside the palette"):
        codec.decode_brick(palette[:100], packed, 8)


def test_bricks_of_a_batch_do_not_mix(spark):
    rng = np.random.default_rng(7)
    bricks = {b: rng.integers(0, [1, 3, 40, 600][b % 4] + 1, 512) for b in range(30)}
    df = spark.createDataFrame([(b, m, int(v)) for b, row in bricks.items() for m, v in enumerate(row) if v], "brick_id long, m long, label long")
    observed = Observation("bricks")
    got = {r.brick_id: (list(r.palette), bytes(r.packed), r.n_symbols) for r in codec.encode(df, 8, observed).collect()}
    assert got == {b: plain_brick(row, 8) for b, row in bricks.items() if row.any()}
    assert observed.get == {"bricks": len(got), "n_symbols": sum(n for *_, n in got.values())}
    with pytest.raises(Exception, match="no such brick: 29"):
        codec.decode(codec.encode(df, 8), 8, bricks=29).collect()


def test_counts_of_every_nth_brick(spark):
    encoded = spark.createDataFrame([(7, b"\x11"), (3, b"\x22"), (9, b"\x33"), (40, b"\x44")], "brick_id long, packed binary")
    got = {r.nibble: r.n for r in codec.symbol_counts(encoded, 2).collect() if r.n}
    assert got == {2: 2, 3: 2}


def test_majority_takes_the_least_among_equals():
    labels, const = codec.pyramid(np.array([5, 3, 5, 3, 9, 9, 1, 2]))
    assert labels[0].tolist() == [3] and not const[0][0]
