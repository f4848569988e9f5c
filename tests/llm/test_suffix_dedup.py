import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from voxelspark.llm import suffix_dedup
from voxelspark.llm.sais import permuted_common_prefixes, sort_suffixes, suffix_array
from voxelspark.llm.suffix_dedup import remove_repeats


def strings(seed):
    rng = random.Random(seed)
    for _ in range(120):
        unit = bytes(rng.randrange(rng.choice([1, 2, 3, 256])) for _ in range(rng.randrange(50)))
        yield unit * rng.choice([1, 1, 2, 5])


@pytest.mark.parametrize("seed", range(3))
def test_suffix_arrays_and_prefixes(seed):
    for raw in strings(seed):
        order = suffix_array(np.frombuffer(raw, np.uint8))
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = permuted_common_prefixes(np.frombuffer(raw, np.uint8), order)
        for a, b in zip(order[1:], order):
            same = next((k for k in range(len(raw)) if a + k >= len(raw) or b + k >= len(raw) or raw[a + k] != raw[b + k]), len(raw))
            assert shared[a] == same
        names = {c: i for i, c in enumerate(sorted(set(raw)))}
        assert sort_suffixes(np.array([names[c] for c in raw], np.int64)).tolist() == order.tolist()


def brute(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    alphabet = "abcdefghij klmnop é漢"
    free = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [free(n) for n in (200, 399, 400, 401, 700, 1500)]
    texts = [free(rng.randrange(50)) + "".join(rng.choice([rng.choice(shared), free(rng.randrange(900))]) for _ in range(rng.randrange(5))) for _ in range(40)]
    base = free(1200)
    texts += [base[: k * 61 % 1000] + free(3) + base[k * 61 % 1000 :] for k in range(25)] + [base, base]
    texts += [None, "", "x", "y" * 399, "z" * 400, "z" * 401, "ab" * 900, "q" * 5000, shared[3] * 3, base[:600] + base[:600]]
    return texts


def check(docs, rows, passage=None):
    got = remove_repeats(docs, passage=passage).collect()
    want = brute([r[1] for r in rows])
    assert Counter((r.doc_id, r.t1, r["_n_bytes"], r["_n_removed"], r["_n_spans"], r["_kept_sha256"]) for r in got) == Counter((r[0], r[3], *w) for r, w in zip(rows, want))
    if passage:
        shorter = brute([r[1] for r in rows], passage)
        assert Counter((r.doc_id, r.t1, r["_passage_bytes"], r["_n_passages"]) for r in got) == Counter((r[0], r[3], w[1], w[2]) for r, w in zip(rows, shorter))
    for r in got:
        if r["_n_spans"] == 0:
            assert r["_kept"] == r.text


@pytest.mark.parametrize("seed,shard,small,passage", [(0, 1 << 20, 10**6, None), (1, 1 << 20, 0, 256), (2, 6000, 10**6, 256), (3, 2000, 0, None), (4, 2000, 0, 120), (5, 500, 10**6, 256)])
def test_matches_brute_force(spark, monkeypatch, seed, shard, small, passage):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)  # small ones deal one core to several shards
    monkeypatch.setattr(suffix_dedup, "SMALL", small)  # 0: the texts that lose something are joined by a shuffle
    texts = corpus(seed)
    rows = [(i if i != 5 else None, t, "found", i) for i, t in enumerate(texts)] + [(3, texts[3], "found", 3)]
    check(spark.createDataFrame(rows, "doc_id long, text string, found string, t1 int").repartition(3), rows, passage)


def test_texts_over_a_slice_and_ties_across_buffers(spark, monkeypatch):
    """Texts longer than a slice, and equal strings of one repeated unit, whose anchors tie, in buffers of different lengths."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 3000)
    rng = random.Random(9)
    free = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    unit, base = free(37), free(9000)
    texts = [base, free(10) + base[2000:7000] + free(900), "xyz" * 1500, free(700) + "xyz" * 900, free(3) + unit * 60, unit * 40 + free(50), (unit * 30)[5:] + free(2000), free(400)]
    rows = [(i, t, "found", i) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id long, text string, found string, t1 int").repartition(2), rows, 256)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
