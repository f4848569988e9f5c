"""Extra columns that have the names of the operators' own columns, in either case, stay as they are or are replaced; results do not change."""

import glob
import os
import re

import pytest

import corpus_pipeline
from voxelspark.llm import chat, langid, licenses, media, minhash, mixing, packing, quality, repair, spotsigs, suffix_dedup, urls

HERE = os.path.dirname(os.path.abspath(chat.__file__))
COLUMNS = {"doc_id", "text", "lang", "source", "n_chars", "url", "page_id", "conv_id", "turn", "role"}
#: All names that begin with "_" in the package's code, and common ones of its steps.
OWN = sorted({n for f in glob.glob(f"{HERE}/*.py") for n in re.findall(r"[\"'`](_[a-z]\w*)[\"'`]", open(f, encoding="utf-8").read())} | set("x node bands label class_id key rep kept0 t1 t2 core d1 size length piece i k prefix digest votes posterior rejected lang_pred score bucket host path shape template purity".split()))


def widened(df):
    have = {c.lower() for c in df.columns}
    extra = {n.lower(): n for n in OWN if n.lower() not in have and n.lower() not in COLUMNS}
    return df.selectExpr("*", *(f"'{n}' as `{n}`" for n in extra.values()))


def passage(n):
    return " ".join(f"w{(n * 31 + i * i * 7) % 997}" for i in range(150))


def documents(spark):
    texts = [passage(k) for k in (1, 1, 2, 3)] + [passage(4) + " tail " + passage(5), passage(6) + " other " + passage(5), "few words", None, ""]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def pages(spark):
    return spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.org/x/1", "http://a.com/de/2", None, "http://a.net/x", "http://a.com/fr/3"])], "page_id long, url string")


def turns(spark):
    return spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi")], "conv_id long, turn long, role string, text string")


RUNS = {
    "urls": (pages, urls.judge_urls), "langid": (documents, lambda d: langid.predict(d, langid.fit(d))), "langid_own": (documents, lambda d: langid.predict(d, langid.fit(d), out=("_lang", "_score", "_rejected"))), "suffix_dedup": (documents, suffix_dedup.remove_repeats),
    "packing": (documents, packing.pack_documents), "pack": (documents, lambda d: packing.pack(d.selectExpr("*", "doc_id % 1 as at", "n_chars % 90 + 1 as len", "0L as crc").drop("piece", "length").withColumnsRenamed({"at": "piece", "len": "length", "crc": "ids_crc32"}))),
    "quality": (documents, quality.judge_quality), "minhash": (documents, minhash.near_duplicates), "keep_one": (documents, minhash.keep_one), "chat": (turns, chat.maximal_conversations), "fingerprints": (documents, spotsigs.fingerprints), "spot_duplicates": (documents, spotsigs.near_duplicates), "repair": (turns, lambda d: repair.repair_conversations(d)[0]), "repaired": (turns, lambda d: repair.repair_conversations(d)[1]), "licenses": (documents, licenses.scan_licenses), "media": (documents, media.media_columns), "mix": (documents, mixing.mix), "take": (documents, mixing.take),
    **{f"stage_{name}": (documents, lambda d, f=f: f(d.sparkSession, d, None)) for name, f in corpus_pipeline.STAGES},
}


@pytest.mark.parametrize("name", RUNS)
def test_results_with_clashing_columns_are_the_same(spark, name):
    make, run = RUNS[name]
    plain = make(spark)
    want, got = run(plain), run(widened(plain))
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    assert set(want.columns) <= set(got.columns)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    if name.startswith("stage_") and name != "stage_packing" or name in ("keep_one", "take"):
        assert got.columns == widened(plain).columns
        assert {r[0] for r in got.select("_id").collect()} <= {"_id"} and {r[0] for r in got.select("_size").collect()} <= {"_size"}
