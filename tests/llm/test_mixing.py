import hashlib
import re

import pytest
from pyspark.sql import functions as F

from voxelspark.llm.mixing import mix, source_targets, take


def test_targets_by_water_filling():
    sizes = {"a": 100, "b": 10, "c": 1000, None: 5}
    got = source_targets(sizes)
    left, w = sum(sizes.values()), {"a": 1, "b": 2, "c": 3, None: 1}
    capped = set()
    while True:  # shares by weight of what is left; the ones above their cap are set to it, and again
        rest = left - sum(3 * sizes[s] for s in capped)
        share = {s: rest * w[s] / sum(w[x] for x in sizes if x not in capped) for s in sizes if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 3 * sizes[s] if s in capped else share[s] for s in sizes})


def nearest(ordered, size, target):
    """Sizes and copies of a source's documents in its order, by trying every single change."""
    at, out = 0, []
    for n in ordered:
        out.append([n, sum(at + k * size + n / 2 < target for k in range(3))])
        at += n
    for _ in range(3):
        gap = target - sum(n * k for n, k in out)
        step = 1 if gap > 0 else -1
        tried = [(abs(gap - step * n), i) for i, (n, k) in enumerate(out) if n and 0 <= k + step <= 3]
        if tried and min(tried)[0] < abs(gap):
            out[min(tried)[1]][1] += step
    return out


def test_mix_matches_brute_force(spark):
    rows = [(i, "w " * (i * 7 % 23 + 1), ["a", "b", "c", None][i * i % 4], "q") for i in range(900)]
    rows += [(5, None, "a", "q"), (None, "x y", "b", "q"), (None, "x y", "b", "q"), (7, "", "d", "q"), (901, "long " * 40000, "b", "q")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"\S+", t or ""))
    targets = source_targets(sizes)
    taken = {}
    for r in got.collect():
        assert r["_copies"] <= 3 and r["_source_size"] == sizes[r.source] and r["_target"] == targets[r.source]
        taken[r.source] = taken.get(r.source, 0) + r["_size"] * r["_copies"]
    want = {}
    for s in sizes:
        mine = [(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, len(re.findall(r"\S+", t or ""))) for i, t, x, _ in rows if x == s]
        want[s] = sum(n * k for n, k in nearest([n for _, _, n in sorted(mine)], sizes[s], targets[s]))
        assert s == "b" or abs(want[s] - targets[s]) <= 1  # b has a document of 40,001 words
    assert taken == want
    again = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5))
    assert sorted(map(str, again.drop("text").collect())) == sorted(map(str, got.drop("text").collect()))


def test_take_repeats_rows_in_order(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    mixed = {r.doc_id: r["_copies"] for r in mix(docs).collect()}
    got = take(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {k: v for k, v in mixed.items() if v}
    assert mix(docs).agg(F.max("_copies")).first()[0] > 1


def test_curriculum_moves_early_weight(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ac"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    got = mix(docs, weights=(1, 1), slopes=(0.9, -0.9)).filter("_copies > 0")
    mean = {r.source: r.m for r in got.groupBy("source").agg(F.avg("_position").alias("m")).collect()}
    assert mean["a"] > mean["c"] + 0.2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0 and take(empty).count() == 0
