import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from voxelspark.llm.quality import COUNTS, accuracies, judge_quality

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [
    None, "", " ", "\n\n", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 50, "größe ñandú 漢字 😀 " * 3, "line one\nline one\n\nline one\r\n \n \n", "###*** $$ %% &&|<>" * 4,
    "tab\tvt\x0bff\x0ccr\rnl\nnbsp\u00a0nel\u0085 zwsp\u200b end", "\n".join(f"row {i} of a text that goes on" for i in range(40)), "\n".join(["same line here again and again and again now"] * 9), "long " * 30000 + "tail",
]


def test_counts_match_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "no id at all", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string, kept int").repartition(2)
    got = judge_quality(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, *(r[c] for c in COUNTS)) for r in got) == sorted((i or -1, *brute(t)) for i, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_empty_table(spark):
    assert judge_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(40000) < 0.85
    rates = np.array([[0.9, 0.999], [0.7, 0.997], [0.6, 0.996], [0.8, 0.998]])
    v = np.where(rng.random((40000, 4)) < np.where(good[:, None], rates[:, 1], rates[:, 0]), good[:, None], ~good[:, None]).astype(int)
    v[rng.random(v.shape) < 0.1] = 2
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    found = accuracies(patterns, counts.astype(float))
    assert found["prior"] == pytest.approx(0.85, abs=0.03)
    assert np.abs(found["right"] - rates.T).max() < 0.07


def test_junk_goes_and_prose_stays(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400)]
    prose = [" ".join(rng.choice(vocabulary, 80)) + "." for _ in range(300)]
    junk = [" ".join(w.upper() + "!!" for w in rng.choice(vocabulary, 80)) for _ in range(30)] + [" ".join(w + "***" for w in rng.choice(vocabulary, 80)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in judge_quality(docs).filter("kept").collect()}
    assert kept == set(range(300))


def plain_posterior(rows, rounds, prior=0.85, start=(0.2, 0.999), weight=20.0, doubt=0.005):
    """Expectation-maximisation document by document."""
    right, p = [[share] * len(rows[0]) for share in start], prior
    good = lambda row: 1 / (1 + math.exp(-odds(row)))

    def odds(row):
        out = math.log(p / (1 - p))
        for j, v in enumerate(row):
            if v == 1:
                out += math.log(right[1][j] / (1 - right[0][j]))
            elif v == 0:
                out += math.log((1 - right[1][j]) / right[0][j])
        return out

    for _ in range(rounds):
        share = [good(r) for r in rows]
        step = [[0.0] * len(rows[0]) for _ in range(2)]
        for y, mass in ((1, share), (0, [1 - g for g in share])):
            for j in range(len(rows[0])):
                agree = sum(m for m, r in zip(mass, rows) if r[j] == y)
                spoke = sum(m for m, r in zip(mass, rows) if r[j] != 2)
                step[y][j] = (agree + weight * start[y]) / (spoke + weight)
        step[1] = [max(x, 1 - doubt) for x in step[1]]
        right, p = step, (sum(share) + weight * prior) / (len(rows) + weight)
    return [good(r) for r in rows]


def test_posterior_equals_document_by_document():
    rng = random.Random(2)
    rows = []
    for _ in range(250):
        bad = rng.random() < 0.2
        rows.append([rng.choice([0, 2]) if rng.random() < (0.4 if bad else 0.02) else rng.choice([1, 1, 2]) for _ in range(10)])
    seen = sorted(Counter(map(tuple, rows)).items())
    found = accuracies(np.array([k for k, _ in seen]), np.array([n for _, n in seen], float), rounds=30)["posterior"]
    told = {k: x for (k, _), x in zip(seen, found)}
    assert [told[tuple(r)] for r in rows] == pytest.approx(plain_posterior(rows, 30), abs=1e-9)
    assert min(found) < 0.5 < max(found)
