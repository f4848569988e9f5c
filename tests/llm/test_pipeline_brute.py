"""Each stage of the pipeline against a brute-force version, on what the stage before it kept."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_minhash import brute as classes
from test_mixing import nearest
from test_packing import plain_best_fit
from tokenizers import Tokenizer

import corpus_pipeline
from voxelspark.llm import langid
from voxelspark.llm.mixing import source_targets

STAGES = dict(corpus_pipeline.STAGES)
VOCABULARY = {"en": "the of and that with from thing nation house water", "de": "der die und das ein ich mit zeitung wasser haus größe"}


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda lang: rng.choice(VOCABULARY[lang].split()) + rng.choice("abcdefg") + rng.choice("hijklm")
    free = lambda lang, n: [word(lang) for _ in range(n)]
    shared = {lang: [" ".join(free(lang, n)) for n in (60, 90, 150)] for lang in VOCABULARY}
    rows = []
    for lang in VOCABULARY:
        for _ in range(30):
            base = free(lang, rng.choice([8, 40, 120, 300]))
            for k in range(rng.choice([1, 1, 2, 4])):
                copy = list(base)
                if k:
                    copy[rng.randrange(len(copy))] = word(lang)
                said = " ".join(copy) + ("\n" + rng.choice(shared[lang]) if rng.random() < 0.3 else "")
                rows.append((said, lang))
    rows += [(rows[3][0], "en"), (rows[3][0], "en"), (" ".join(free("de", 6000)), "de"), (None, "en"), ("", "de"), ("12 34 ?!", None), ("the of and that", None)]
    rng.shuffle(rows)
    return [(i, t, lang, ["a", "b", "b", "b", "c", None][i % 6], len(t or "")) for i, (t, lang) in enumerate(rows)]


def told(text, model):
    """Language and probability of one text, n-gram by n-gram."""
    raw = b" " + "".join(c if c.isalpha() else " " for c in (text or "").lower()).encode() + b" "
    counts = np.zeros((1, langid.BUCKETS), np.float32)
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if 32 in gram[1:-1] or gram[0] == gram[-1] == 32:
                continue
            h = 0
            for byte in gram:
                h = (h * 0x01000193 + byte) & 0xFFFFFFFF
            counts[0, ((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % langid.BUCKETS] += 1
    p = model.probabilities(counts)[0]
    return model.languages[p.argmax()], p.max()


def without_repeats(texts, length=256):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for text, raw in zip(texts, raws):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if times[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        yield np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else text


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def copies(rows):
    """How often the mix takes each document."""
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += words(t)
    targets, out = source_targets(sizes), {}
    for s in sizes:
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, words(t)) for i, t, _, x, _ in rows if x == s)
        out |= {i: k for (_, i, _), (_, k) in zip(mine, nearest([n for _, _, n in mine], sizes[s], targets[s]))}
    return out


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def step(name, rows):
        STAGES[name](spark, docs_of(rows), None).write.parquet(f"{tmp_path}/{name}")
        return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()]

    docs_of = lambda rows: spark.createDataFrame(rows, docs.schema).repartition(3)
    rows = corpus()

    model = langid.fit(docs)
    close = {r[0] for r in rows if abs(told(r[1], model)[1] - model.threshold) < 1e-4}
    want = {r[0] for r in rows if re.search(r"[^\W\d_]", r[1] or "") and told(r[1], model)[1] >= model.threshold}
    kept = step("language", rows)
    assert {r[0] for r in kept} - close == want - close and len(kept) >= len(rows) - 5
    assert set(kept) <= set(rows)

    one = step("near_duplicates", kept)
    assert sorted(r[0] for r in one) == sorted({c for _, c in classes([(r[0], r[1]) for r in kept])})
    assert set(one) <= set(kept) and len(one) < 0.8 * len(kept)

    cut = step("repeated_passages", one)
    expected = list(without_repeats([r[1] for r in one]))
    assert sorted(map(str, cut)) == sorted(str((r[0], t, r[2], r[3], len(t))) for r, t in zip(one, expected))
    assert sum(t != r[1] for r, t in zip(one, expected)) > 5

    mixed = step("mixing", cut)
    times = copies(cut)
    assert Counter(mixed) == Counter({r: times[r[0]] for r in cut if times[r[0]]})
    assert max(times.values()) > 1 and min(times.values()) == 0

    STAGES["packing"](spark, docs_of(mixed), None).write.parquet(f"{tmp_path}/packing")
    packed = spark.read.parquet(f"{tmp_path}/packing").collect()
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        pieces.update((r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    fill = defaultdict(list)
    for r in packed:
        fill[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in spans) <= 2048 and [a for a, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]] for spans in fill.values())
    assert len(fill) == sum(plain_best_fit([r.length for r in packed], 2048).values())
