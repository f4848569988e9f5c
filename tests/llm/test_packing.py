import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxelspark.llm.packing import CapacityTree, Encoder, best_fit_decreasing, pack_documents


def plain_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, free in enumerate(bins) if free >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(size - n)
    return Counter(bins)


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_bins_equal_piece_by_piece(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 37, 100, 256])
    lengths = [rng.randint(1, rng.choice([size, size // 2, size // 4 + 1])) for _ in range(rng.choice([1, 50, 400]))]
    counts = Counter(lengths)
    placed, bins = best_fit_decreasing(counts, size)
    placed.sort(key=lambda p: (p[0], p[1]))
    fill = defaultdict(list)
    for n in counts:
        rows = [p for p in placed if p[0] == n]
        for rank in range(counts[n]):
            _, r0, each, first, used = [p for p in rows if p[1] <= rank][-1]
            fill[first + (rank - r0) // each].append((used + (rank - r0) % each * n, n))
    assert len(fill) == bins
    for spans in fill.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= size
    assert Counter(size - sum(n for _, n in s) for s in fill.values()) == plain_best_fit(lengths, size)


def test_capacity_tree():
    tree, rng, have = CapacityTree(100), random.Random(2), Counter()
    for _ in range(2000):
        c = rng.randint(0, 100)
        k = -have[c] if rng.random() < 0.5 else rng.randint(1, 3)
        tree.add(c, k)
        have[c] += k
        least = rng.randint(0, 100)
        assert tree.tightest(least) == min((x for x in have if x >= least and have[x]), default=None)


def test_pack_documents(spark):
    texts = [None, "", "hello world", "<|endoftext|> a special <|endoftext|>", "größe 漢字 😀", "word " * 9000, "x" * 5000, " \n\t ", "hello world"] + [f"text {i} " * (i % 90) for i in range(300)]
    rows = [(i if i != 7 else None, t, "s") for i, t in enumerate(texts)] + [(2, "hello world", "s")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= 2048
    assert len(fill) == sum(plain_best_fit([r.length for r in got], 2048).values())
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_are_those_of_tokenizers():
    file = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    fast, slow, rng = Encoder(file), Tokenizer.from_str(file), random.Random(12)
    ranges = [(32, 127), (9, 14), (160, 592), (0x300, 0x370), (0x400, 0x530), (0x600, 0x700), (0x900, 0xA00), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE00, 0xFFFE), (0x1F300, 0x1FAFF), (0x10000, 0x110000)]
    for _ in range(4000):
        some = [rng.choice(ranges) for _ in range(rng.randint(1, 3))]
        text = "".join(chr(rng.randrange(*rng.choice(some))) if rng.random() < 0.8 else rng.choice(" \n'stld0") for _ in range(rng.randint(0, 40)))
        assert fast.ids(text) == slow.encode(text, add_special_tokens=False).ids
