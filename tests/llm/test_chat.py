import random
from collections import Counter

from voxelspark.llm.chat import maximal_conversations


def brute(rows):
    low = lambda v: (v is not None, v if v is not None else "")
    convs = {}
    for c, t, role, text, *_ in rows:
        convs.setdefault(c, []).append((low(t) if t is None else (True, t), low(role), low(text)))
    seqs = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda v: (v[0][0], v[0][1] if v[0][0] else 0, v[1], v[2]))) for c, v in convs.items()}
    begun = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    times = Counter(seqs.values())
    out = {}
    for c in sorted(seqs, key=lambda c: (c is None, c or 0)):
        s = seqs[c]
        if s not in begun and s not in {v[0] for v in out.values()}:
            out[c] = (s, times[s])
    say = lambda s: "".join(f"<|im_start|>{r[1] if r[0] else 'unknown'}\n{x[1]}<|im_end|>\n" for r, x in s)
    return sorted(((c if c is not None else -1), len(s), n, say(s)) for c, (s, n) in out.items())


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(80):
        base = rng.randrange(12)
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user"]) if t % 2 == 0 else "assistant", f"text {base} {t if rng.random() < 0.9 else rng.random()}", 1))
    rows += [(90, None, None, None, 1), (90, None, None, None, 1), (91, 0, "user", None, 2), (91, 0, "user", "", 2), (None, 0, "user", "lost", 3), (92, 5, "user", "x" * 50000, 1)]
    got = maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").repartition(3)).collect()
    assert sorted((r.conv_id if r.conv_id is not None else -1, r.n_turns, r.n_copies, r.text) for r in got) == brute(rows)


def test_empty_table(spark):
    assert maximal_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
