import pytest
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxelspark.llm.common import text_buffer
from voxelspark.llm.langid import LETTERS, fit, held_out, ngram_counts, predict

WORDS = {"aa": "the of and that with from ing tion".split(), "bb": "der die und das ein ich mit ung".split(), "cc": "été le la les des où être çà".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n))


def brute_ngrams(t):
    raw = bytes(LETTERS[b] for b in t.replace("É", "é").encode())
    padded = b" " + raw + b" "
    return sum(1 for n in (2, 3, 4) for i in range(len(padded) - n + 1) if 32 not in padded[i + 1 : i + n - 1] and not (padded[i] == 32 and padded[i + n - 1] == 32))


def test_ngrams_stay_within_documents():
    texts = ["", "a", "ab cd", "É é", "x1y, z", "", "longer words here"]
    together = ngram_counts(*text_buffer(pa.array(texts)))
    alone = np.concatenate([ngram_counts(*text_buffer(pa.array([t]))) for t in texts])
    assert (together == alone).all()
    assert together.sum(1).tolist() == [brute_ngrams(t) for t in texts]
    assert (ngram_counts(*text_buffer(pa.array(["ÉÀ Ab"]))) == ngram_counts(*text_buffer(pa.array(["éà aB"])))).all()


def test_held_out_accuracy_and_rejection(spark):
    rng = np.random.default_rng(0)
    rows = [(i, text(rng, lang, rng.integers(2, 60)), lang, 0.0) for i in range(600) for lang in [list(WORDS)[i % 3]]]
    odd = [(1000, None, "aa", 0.0), (1001, "", "bb", 0.0), (1002, "12 34 !?", None, 0.0), (None, "the of and that", None, 0.0), (1003, "x", None, 0.0), (1004, "der die das " * 20000, None, 0.0), (5, rows[5][1], rows[5][2], 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double").repartition(3)
    model = fit(docs.filter(~held_out()))
    got = predict(docs, model).withColumn("held", held_out()).collect()
    assert len(got) == len(rows) + len(odd)
    test = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 1000]
    assert len(test) > 100 and np.mean([r.lang == r.lang_pred for r in test]) > 0.99
    assert np.mean([r.rejected for r in test]) < 0.02
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[1004].lang_pred == "bb" and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    again = predict(docs.repartition(5), fit(docs.repartition(5).filter(~held_out()))).select("doc_id", "lang_pred", F.round("score", 5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, predict(docs, model).select("doc_id", "lang_pred", F.round("score", 5)).collect()))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert fit(docs) is None
    assert [(r.lang_pred, r.rejected) for r in predict(docs, None).collect()] == [("und", True)]
    empty = docs.limit(0)
    assert fit(empty) is None and predict(empty, None).count() == 0


def test_small_languages_keep_their_rows(spark, monkeypatch):
    """Large languages are drawn with a reserve, which is cut from themselves."""
    from collections import Counter

    from voxelspark.llm import langid

    sizes, seen = {"aa": 3000, "bb": 3000, "cc": 3000, "dd": 90}, []
    monkeypatch.setattr(langid, "train", lambda counts, labels: seen.append(Counter(labels)))
    rows = [(i, f"{k} word{i}", k) for i, k in enumerate(k for k, n in sizes.items() for _ in range(n))]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    assert seen[0]["dd"] == 90 and max(seen[0].values()) <= 100 and min(seen[0].values()) > 70


def test_sample_reaches_the_driver_in_parts(spark):
    """One job's results may be smaller than the sample."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(200)), "ab"[i % 2]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "4m")  # 500 rows have about 15 KB each
    try:
        model = fit(docs)
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert model.languages == ["a", "b"]


@pytest.mark.parametrize("wrong", [0.0, 0.03])
def test_wrong_labels_do_not_reject_clean_rows(wrong):
    from voxelspark.llm.langid import FLOOR, Model, calibrate

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 2000)
    logits = np.where(np.arange(2) == y[:, None], rng.uniform(4, 9, (2000, 1)), 0.0)
    y = np.where(rng.random(2000) < wrong, 1 - y, y)
    model = Model(["aa", "bb"], np.zeros((4, 2), np.float32), np.zeros((2, 2), np.float32), np.zeros(2, np.float32))
    calibrate(model, logits, y)
    assert model.threshold == FLOOR
