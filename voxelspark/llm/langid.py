"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy, with calibrated rejection.

A text is the mean of the embeddings of its byte n-grams within words (a space marks a word's edge), hashed to buckets. The probabilities are calibrated by a temperature on rows held back from training, and a text is rejected if its calibrated probability is below a threshold fitted on the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shielded, slices, table, text_buffer, unshielded

BUCKETS, DIMENSIONS = 4096, 16
NGRAMS = (2, 3, 4)
#: Rows of a language that the classifier is fitted on, at most. Each sends its n-gram counts, at most BUCKETS, to the driver.
SAMPLE = 1000
#: Languages that the classifier is fitted on, at most: those of the most rows, by name among equals.
LANGUAGES = 512
#: Rows that go to the driver at a time, unless that takes more than FETCHES turns.
FETCH, FETCHES = 128, 256
#: Share of the accepted rows that should be right, and the least probability that is accepted.
TARGET, FLOOR = 0.99, 0.5
#: Share of the rows of a probability from FLOOR on that a higher threshold must still accept; where labels are wrong at all scores, it stays at FLOOR.
ACCEPTED = 0.5
UNKNOWN = "und"

LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def ngram_counts(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed n-grams by document, as an array of documents by buckets."""
    n = len(offsets) - 1
    at = offsets + np.arange(1, n + 2)  # a space before each document and after the last
    text = np.full(len(data) + n + 1, 32, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    text[np.arange(len(data)) + doc + 1] = LETTERS[data]
    lower = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97)
    text[1:][lower] |= 0x20  # capitals of Latin-1
    space = text == 32
    of = np.searchsorted(at, np.arange(len(text)) + 1, "right") - 1  # an n-gram is of the document whose space or byte it begins with
    out = np.zeros(n * buckets, np.float32)
    h = text.astype(np.uint32)
    rolled, inner = h.copy(), np.zeros(len(text), bool)
    for size in range(2, max(NGRAMS) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + h[size - 1 :]
        if size > 2:
            inner = inner[:-1] | space[size - 2 : len(text) - 1]
        else:
            inner = inner[:-1]
        if size in NGRAMS:
            last = len(text) - size + 1
            good = ~inner & ~(space[:last] & space[size - 1 :]) & (of[:last] < n)
            bucket = ((rolled * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(buckets)
            out += np.bincount(of[:last][good] * buckets + bucket[good], minlength=n * buckets)
    return out.reshape(n, buckets)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = FLOOR

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return (scaled(counts) @ self.embeddings) @ self.weights + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(counts) / self.temperature)


def scaled(counts: np.ndarray) -> np.ndarray:
    return counts * (np.sqrt(counts.shape[1]) / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Rows:
    """Bucket counts of rows, kept sparse; indexing by row numbers gives them as an array."""

    def __init__(self, rows: list[tuple[bytes, bytes]], buckets: int = BUCKETS):
        self.rows, self.buckets = rows, buckets

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, which) -> np.ndarray:
        out = np.zeros((len(which), self.buckets), np.float32)
        for k, i in enumerate(which):
            index, counts = self.rows[i]
            out[k, np.frombuffer(index, "<u2")] = np.frombuffer(counts, "<f4")
        return out


def train(counts: Rows, labels: list[str], epochs: int = 12, batch: int = 32, rate: float = 0.5, decay: float = 1e-5, seed: int = 7) -> Model:
    """Fits embeddings, weights and bias on four fifths of the rows, temperature and threshold on the rest."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    model = Model(languages, rng.normal(0, 0.1, (counts.buckets, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    steps, done = max(1, epochs * -(-len(fit) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            rows = fit[i : i + batch]
            x = scaled(counts[rows])
            hidden = x @ model.embeddings
            error = softmax(hidden @ model.weights + model.bias).astype(np.float32)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= rate * (1 - done / steps) / len(rows)
            back = x.T @ (error @ model.weights.T)
            model.weights -= hidden.T @ error + decay * model.weights
            model.bias -= error.sum(0)
            model.embeddings -= back + decay * model.embeddings
            done += 1
    if len(held):
        logits = np.concatenate([model.logits(counts[held[i : i + batch]]) for i in range(0, len(held), batch)])
        calibrate(model, logits, y[held])
    return model


def calibrate(model: Model, logits: np.ndarray, y: np.ndarray, target: float = TARGET, floor: float = FLOOR) -> None:
    """The temperature of least log loss, and the least threshold from ``floor`` on above which a share of ``target`` is right, or ``floor`` if no threshold reaches that and accepts a share of ``ACCEPTED`` of the rows from ``floor`` on."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 41)), key=loss))
    p = softmax(logits / model.temperature)
    score, right = p.max(1), p.argmax(1) == y
    model.threshold = floor
    for t in [floor, *np.sort(score[score > floor])]:
        above = score >= t
        if above.sum() < ACCEPTED * (score >= floor).sum():
            break
        if above.any() and right[above].mean() >= target:
            model.threshold = float(t)
            break


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """A model of at most ``sample`` rows a language, of at most ``LANGUAGES`` languages, of the labelled rows of ``docs``; None without any.

    Rows are drawn by a hash of ``order``, ties in order of their n-gram counts. Rows of null label, and texts that are null or have no letter, are left out; repeated rows are drawn together and count as often as they come. A text is counted whole, in one task. Counts reach the driver a few rows at a time, so its JVM never holds the sample. Jobs run here.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in docs.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    draw = F.xxhash64(F.coalesce(F.col(order).cast("string"), F.lit("")), F.lit(11))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 1.1 * sample / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw")).join(F.broadcast(shares), "lang")
    drawn = drawn.filter(F.shiftrightunsigned("draw", 11) < F.col("share") * float(1 << 53)).select("lang", "draw", "text")

    def run(batches):
        for part in slices(batches):
            counts = ngram_counts(*text_buffer(part.column("text")))
            rows = [(np.flatnonzero(c).astype("<u2"), c) for c in counts]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([c[i].astype("<f4").tobytes() for i, c in rows], pa.binary())], names=["lang", "draw", "i", "c"])

    first = F.row_number().over(W.partitionBy("lang").orderBy("draw", "i", "c"))
    rows = drawn.mapInArrow(run, "lang string, draw long, i binary, c binary").withColumn("first", first).filter(F.col("first") <= sample).select("draw", "lang", "i", "c")
    turns = min(FETCHES, -(-sum(min(sample, n) for n in sizes.values()) // FETCH))
    rows = sorted((draw, name, bytes(i), bytes(c)) for draw, name, i, c in rows.repartition(turns).toLocalIterator())
    if not rows:
        return None
    return train(Rows([(i, c) for _, _, i, c in rows]), [name for _, name, _, _ in rows])


def predict(docs: DataFrame, model: Model | None, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language, its calibrated probability, and whether it is rejected.

    Null texts and texts without a letter are "und" with score 0, and rejected. Without a model, so is every text. A text is judged whole, in one task, and alone, so repeated rows are judged alike and stay repeated; an empty table gives an empty result. Of languages of equal probability, the first by name is told. Columns of ``docs`` with the names of ``out`` are replaced.
    """
    docs, old, (text,) = shielded(docs, text)
    own = {c.lower() for c in out}
    clash = [c for c in docs.columns if c.lower() not in own]
    docs = docs.select(*(f"`{c}`" for c in clash))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "_letter boolean"])

    def run(batches):
        known = model
        for part in slices(batches):
            n = part.num_rows
            letter = part.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            if known is None:
                names, score, bad = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            else:
                p = known.probabilities(ngram_counts(*text_buffer(part.column(text))))
                best = p.argmax(1)
                names = [known.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                score = np.where(letter, p.max(1), 0.0).astype(np.float64)
                bad = ~letter | (score < known.threshold)
            columns = [part.column(c) for c in part.schema.names if c != "_letter"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score), pa.array(bad)], names=[*clash, *out])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    kinds = ddl.removesuffix(", _letter boolean")
    return unshielded(docs.withColumn("_letter", letter).mapInArrow(run, f"{kinds}, {out[0]} string, {out[1]} double, {out[2]} boolean"), old)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
