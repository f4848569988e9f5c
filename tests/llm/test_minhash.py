import random
import re
from collections import Counter

import numpy as np
import pytest

from voxelspark.llm import minhash
from voxelspark.llm.common import text_buffer
from voxelspark.llm.minhash import components, dart_signatures, keep_one, near_duplicates, shingle_counts


def multiset(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def similarity(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum((a & b).values()) / sum((a | b).values())


def brute(rows):
    """Class by row, the transitive closure of all pairs of similarity 0.8 or more."""
    sets = [multiset(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((-1 if d is None else d, ids[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=25):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(600)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, len(base) // 60, len(base) // 30])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_matches_all_pairs(spark, seed):
    texts = corpus(seed) + [None, "", " \n ", "one", "one", "one two", "a b c d e", "a b c d e f", "same " * 300, "same " * 290, "same " * 100, "word " * 30000 + "end"]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(3, texts[2]), (None, texts[5])]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, x string, node int").repartition(3)
    got = near_duplicates(docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_signatures_estimate_weighted_similarity():
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"w{i}" for i in range(60, 300)) + " " + "again " * 40
    import pyarrow as pa

    s = dart_signatures(*shingle_counts(*text_buffer(pa.array([a, b, "", "short"]))), 4, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(similarity(multiset(a), multiset(b)), abs=0.03)
    assert not s[2].any() and s[3].all()
    assert len(np.unique(s[3])) == 4000


def test_signatures_of_any_weights():
    """Weights that are no counts, from a fraction of one region to several regions."""
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0.05, 9, (2, 200))
    b[:120] = a[:120] * rng.uniform(0.7, 1.3, 120)
    elements = rng.integers(1, 1 << 63, 200).astype(np.uint64)
    s = dart_signatures(np.tile(elements, 2), np.repeat([0, 1], 200), np.concatenate([a, b]), 2, 6000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.025)
    alone = dart_signatures(elements, np.zeros(200, int), a, 1, 6000)
    assert (alone[0] == s[0]).all()


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60) if i != 30] + [(100, 101), (101, 102), (100, 102)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 100: 100, 101: 100, 102: 100}


def test_components_take_few_tasks_for_few_arcs(spark):
    """Partitions of shuffles may be many more than small graphs need."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
        assert got.rdd.getNumPartitions() == 1 and {r.label for r in got.collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    texts = corpus(9, 10)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(2, texts[2], "en"), (2, texts[2], "fr"), (None, "alone here", "en"), (None, "alone here", "en"), (900, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = keep_one(docs)
    assert got.columns == docs.columns
    classes = near_duplicates(docs).select("class_id").distinct().count()
    assert got.count() == classes == near_duplicates(got).select("class_id").distinct().count()


def test_pairs_among_documents_with_much_in_common(spark):
    rng = random.Random(5)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shared, texts = some(200), []
    for _ in range(60):
        base = shared + some(45)
        copy = list(base)
        for at in rng.sample(range(len(copy)), 4):
            copy[at] = some(1)[0]
        texts += [" ".join(base), " ".join(copy)]
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def near_leaders(count):
    """Rows of ``count`` documents that share so many words that no two of them are alike, and a near copy of each."""
    rng = random.Random(8)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shared, texts = some(262), []
    for _ in range(count):
        base = shared + some(38)
        copy = list(base)
        for at in (265, 295):
            copy[at] = some(1)[0]
        texts += [" ".join(base), " ".join(copy)]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [16, 128])
def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch, block):
    """Leaders link nobody but their own copies, so a pair that never has a leader is found only by comparing all members of a bucket."""
    monkeypatch.setattr(minhash.links, "__defaults__", (block,))
    rows = near_leaders(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed = minhash.signatures(docs, "text", "doc_id", 3, 1, minhash.SHINGLE).collect()
    bands = {r.doc_id: set(r.bands) for r in signed}
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if bands[a] & bands[b] and similarity(sets[a], sets[b]) >= minhash.SIMILARITY:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = near_duplicates(docs, bands=3, rows=1)
    assert {r.doc_id: r.class_id for r in got.collect()} == {a: root(a) for a in range(len(rows))}


def test_component_of_a_hub(spark):
    """A node that thousands are linked to, and a chain beside it."""
    edges = [(5000, i) for i in range(4000)] + [(i, i + 1) for i in range(6000, 6040)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(4000), 5000]}, **{i: 6000 for i in range(6000, 6041)}}


def test_many_copies_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text if i % 3 == 0 else text + f" tail{i % 2}" if i % 3 == 1 else f"alone {i} of its kind {i + 1} here {i}") for i in range(600)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i % 3 < 2 else i for i in range(600)}
