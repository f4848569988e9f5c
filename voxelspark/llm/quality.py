"""Quality rules by weak supervision.

Each rule votes good or bad on a document, or abstains. Expectation-maximisation over the counts of all vote patterns estimates how often each rule is right about good and about bad documents, and the posterior probability of good replaces a filter that asks for all rules to pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, slices, table, text_buffer

WINDOW = 8
#: Rules by name: the measure, and the sides from which it votes bad and good; what lies between abstains.
RULES = {
    "length": ("n_words", "<", 20, ">=", 50),
    "short_words": ("mean_word", "<", 2.0, ">=", 2.6),
    "long_words": ("mean_word", ">", 15.0, "<=", 10.0),
    "symbols": ("symbols_per_word", ">", 0.1, "<=", 0.02),
    "repeated_lines": ("dup_line_share", ">", 0.5, "<=", 0.1),
    "repeated_words": ("repeat_share", ">", 0.3, "<=", 0.1),
    "capitals": ("capital_share", ">", 0.5, "<=", 0.2),
    "exclamations": ("exclaims_per_word", ">", 0.2, "<=", 0.05),
    "one_word": ("top_share", ">", 0.3, "<=", 0.15),
    "letters": ("letter_share", "<", 0.5, ">=", 0.75),
}
MASK64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE, SYMBOL, CAPITAL, SMALL = _class(b" \t\n\x0b\x0c\r"), _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Ranges:
    """64-bit hashes of any byte ranges of a buffer: prefix sums of byte * BASE^place, brought back to place 0."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, back = np.full(n + 1, BASE, np.uint64), np.full(n + 1, INVERSE, np.uint64)
        power[0] = back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(back, out=back)
        self.back = back
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the runs of ``inside``, cut where documents begin."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside])[:-1] if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a buffer of UTF-8 texts."""
    n = len(offsets) - 1
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    word = ~SPACE[data]
    starts, ends, doc = spans(word, offsets)
    ranges = Ranges(data)
    hashes = ranges.hash(starts, ends)
    n_words = np.bincount(doc, minlength=n)

    repeat = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        count = len(starts) - WINDOW + 1
        rolled = np.zeros(count, np.uint64)
        for j in range(WINDOW):
            rolled += hashes[j : j + count] * np.uint64(pow(BASE, j + 1, 1 << 64))
        at = np.flatnonzero(doc[:count] == doc[WINDOW - 1 :])
        keys = mixed(rolled[at]) + doc[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, twice, 1)
        np.add.at(change, twice + WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(change)[:-1] > 0], minlength=n)

    top = np.zeros(n, np.int64)
    if len(starts):
        _, first, times = np.unique(hashes + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), return_index=True, return_counts=True)
        np.maximum.at(top, doc[first], times)

    begin, end, line_doc = spans(data != 10, offsets)
    seen = np.concatenate([[0], np.cumsum(word)])
    full = seen[end] > seen[begin]
    begin, end, line_doc = begin[full], end[full], line_doc[full]
    lines = np.bincount(line_doc, minlength=n)
    keys = ranges.hash(begin, end) + line_doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    _, first = np.unique(keys, return_index=True)
    dup = lines - np.bincount(line_doc[first], minlength=n)

    return {
        "n_words": n_words, "word_chars": per(word & ((data & 0xC0) != 0x80)), "n_symbols": per(SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": repeat,
        "n_lines": lines, "capitals": per(CAPITAL[data]), "letters": per(CAPITAL[data] | SMALL[data] | (data >= 0xC3)), "exclaims": per(data == 33), "top": top,
    }


def votes(m: dict[str, np.ndarray], rules=RULES) -> np.ndarray:
    """A column for each rule: 1 good, 0 bad, 2 abstains."""
    share = lambda a, b: a / np.maximum(b, 1)
    of = {
        "n_words": m["n_words"], "mean_word": np.where(m["n_words"] > 0, share(m["word_chars"], m["n_words"]), 5.0), "symbols_per_word": share(m["n_symbols"], m["n_words"]), "dup_line_share": share(m["n_dup_lines"], m["n_lines"]),
        "repeat_share": share(m["n_repeat_words"], m["n_words"]), "capital_share": share(m["capitals"], m["letters"]), "exclaims_per_word": share(m["exclaims"], m["n_words"]), "top_share": np.where(m["n_words"] >= 20, share(m["top"], m["n_words"]), 0.0), "letter_share": np.where(m["word_chars"] > 0, share(m["letters"], m["word_chars"]), 1.0),
    }
    compare = {"<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal}
    out = np.full((len(m["n_words"]), len(rules)), 2, np.int8)
    for j, (name, bad, low, good, high) in enumerate(rules.values()):
        out[compare[good](of[name], high), j] = 1
        out[compare[bad](of[name], low), j] = 0
    return out


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, prior: float = 0.85, start=(0.2, 0.999), weight: float = 20.0, doubt: float = 0.005) -> dict:
    """Expectation-maximisation over vote patterns (rows of 1 good, 0 bad, 2 abstains) and their counts.

    ``start`` has the share of right votes about bad and about good documents from which the steps begin: a bad document trips few of the rules, a good one hardly any. It and ``prior`` (the share of good documents) enter each step as ``weight`` imagined documents a class, so that no estimate reaches 0 or 1. A rule is wrong about at most ``doubt`` of the good documents; without that, the class of good ones takes in a kind of junk that a single rule sees. Returns right (share of right votes by class, bad and good), prior, and each pattern's posterior of good.
    """
    begin = np.repeat(np.array(start)[:, None], patterns.shape[1], 1)
    right, p = begin, prior
    for _ in range(rounds):
        good = _posterior(patterns, right, p)
        new = (counts @ good + weight * prior) / (counts.sum() + weight)
        step = np.empty_like(right)
        for y, share in ((1, good), (0, 1 - good)):
            mass = (counts * share)[:, None]
            step[y] = ((mass * (patterns == y)).sum(0) + weight * begin[y]) / ((mass * (patterns != 2)).sum(0) + weight)
        step[1] = np.maximum(step[1], 1 - doubt)
        done = abs(new - p) < 1e-9 and np.abs(step - right).max() < 1e-9
        p, right = new, step
        if done:
            break
    return {"right": right, "prior": p, "posterior": _posterior(patterns, right, p)}


def _posterior(patterns: np.ndarray, right: np.ndarray, p: float) -> np.ndarray:
    odds = np.full(len(patterns), np.log(p) - np.log(1 - p))
    for j in range(patterns.shape[1]):
        says_good = np.log(right[1, j]) - np.log(1 - right[0, j])
        says_bad = np.log(1 - right[1, j]) - np.log(right[0, j])
        odds += np.where(patterns[:, j] == 1, says_good, np.where(patterns[:, j] == 0, says_bad, 0.0))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules=RULES, keep: float = 0.5) -> DataFrame:
    """A row for each row of ``docs``: doc_id, the five counts, base_failed, votes, posterior and kept.

    The accuracies are those of all rows: votes are counted by pattern (at most 3 to the number of rules), and only the counts go to the driver. kept is false if base_failed, else whether the posterior of good is at least ``keep``. Null and empty texts have no words and fail the base rules. Repeated rows count as often as they come; null ids stay null; an empty table gives an empty result; other columns are left out.
    """
    names = list(COUNTS)

    def run(batches):
        for part in slices(batches, rows=2048, size=2 << 20):
            m = measures(*text_buffer(part.column("text")))
            pattern = ["".join(map(str, v)) for v in votes(m, rules)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[k].astype(np.int64)) for k in names), pa.array(pattern, pa.string())], names=["doc_id", *names, "votes"])

    measured = checkpoint(docs.selectExpr(f"cast(`{doc_id}` as bigint) as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", votes string"))
    seen = measured.groupBy("votes").count().orderBy("votes").collect()
    if seen:
        found = accuracies(np.array([[int(c) for c in r[0]] for r in seen]), np.array([r[1] for r in seen], float))
        posterior = docs.sparkSession.createDataFrame([(r[0], float(p)) for r, p in zip(seen, found["posterior"], strict=True)], "votes string, posterior double")
    else:
        posterior = docs.sparkSession.createDataFrame([], "votes string, posterior double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.join(F.broadcast(posterior), "votes", "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep)).select("doc_id", *names, "base_failed", "kept", "posterior", "votes")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
