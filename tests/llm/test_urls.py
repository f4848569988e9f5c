import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxelspark.llm.urls import RULES, judge_urls, shape, template_tree


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for said, rule in RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return host, path, best and best[1], best and best[0]


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/1?x=1#y", "https://example.org/en/12", "https://example.org/en/2", "https://badexample.org/es/1", "ftp://x.com/fr/a/b", "x://com/fr/", "http://Com/fr", "http://x.com/de/",
    "http://x.com?de/", "http://x.org", "http://x.org#/a", "http://É.org/es/", "a://b://c.org/x", "http://user@h.org:80/p//q/", "http://x.net/" + "/".join("abcdefghijklmnop"), "http://x.net/" + "y" * 20000,
]


def test_rules_match_brute_force(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS)] + [(4, URLS[4], "h", None), (None, None, None, None)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, path string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, said = brute(r.url)
        assert (r["_host"], r["_path"], r["_rule"]) == (host, path, rule)
        assert r["_verdict"] == (said or r["_verdict"]) and r["_verdict"] in ("allow", "block")


def test_tree_rejects_pure_templates_and_merges_like_branches(spark):
    rows = [(f"http://h.net/spam/{i}", 1) for i in range(60)] + [(f"http://h.net/{w}/{i}.html", 0) for w in ("news", "blog", "wiki") for i in range(40)]
    rows += [("http://h.net/spam/x7", None), ("http://h.net/talk/1.html", None), ("http://other.net/spam/1", None)]
    got = {r.url: r for r in judge_urls(spark.createDataFrame(rows, "url string, bad int"), rules=(), label="bad").collect()}
    assert got["http://h.net/spam/x7"]["_verdict"] == "block" and got["http://h.net/spam/x7"]["_template"].startswith("/spam/")
    assert {got[f"http://h.net/{w}/3.html"]["_template"] for w in ("news", "blog", "wiki")} == {"/*-/#.html"}
    assert got["http://h.net/talk/1.html"]["_verdict"] == "allow" and got["http://other.net/spam/1"]["_verdict"] == "allow"


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_branches_that_differ_deep_down_are_told_apart(spark):
    deep = "a/b/c/d/e/f/g/h/i/j"
    rows = [(f"https://h.com/{deep}/{kind}/x/{i}", bad) for kind, bad in (("good", 0), ("bad", 1)) for i in range(30)]
    rows += [(f"https://pure.com/{deep}/{kind}/{i}", 1) for kind in ("s", "t") for i in range(30)]
    got = judge_urls(spark.createDataFrame(rows, "url string, label int"), rules=(), label="label").collect()
    assert {(r.label, r._verdict) for r in got if r._host == "h.com"} == {(0, "allow"), (1, "block")}
    assert len({r._template for r in got if r._host == "h.com"}) == 2
    assert {r._template.split("/")[-1] for r in got if r._host == "pure.com"} == {"**"}


def plain_tree(pages, prior=2.0, z=2.0):
    """Templates and purities of (host, shape), level by level and branch by branch."""

    def score(b, m, rb, rm):
        pooled = (b + rb + 1) / (m + rm + 2)
        return abs((b + 1) / (m + 2) - (rb + 1) / (rm + 2)) / math.sqrt(pooled * (1 - pooled) * (1 / (m + 2) + 1 / (rm + 2)))

    counts = defaultdict(lambda: [0, 0])
    for host, shape, bad in pages:
        counts[host, shape][0] += bad or 0
        counts[host, shape][1] += bad is not None
    total = lambda keys: [sum(counts[k][i] for k in keys) for i in (0, 1)]
    state = {}
    for k in counts:
        b, m = total([q for q in counts if q[0] == k[0]])
        state[k] = ("", (b + prior / 2) / (m + prior))
    for d in range(max(len(k[1].split("/")) for k in counts)):
        segment = lambda k: (k[1].split("/") if k[1] else [])[d : d + 1]  # noqa: B023, E731
        nodes, after = defaultdict(lambda: defaultdict(list)), dict(state)
        for k in counts:
            if segment(k):
                nodes[k[0], state[k][0]][segment(k)[0]].append(k)
        for (host, above), branches in nodes.items():
            nb, nm = total([k for ks in branches.values() for k in ks])
            at = {c: total(ks) for c, ks in branches.items()}
            own = {c for c, (b, m) in at.items() if score(b, m, nb - b, nm - m) >= z}
            side = {c: "+" if (b + 1) / (m + 2) > (nb - b + 1) / (nm - m + 2) else "-" for c, (b, m) in at.items()}
            named = {}
            for c, (b, m) in at.items():
                like = [at[x] for x in own if side[x] == side[c]]
                sb, sm = (sum(x[i] for x in like) for i in (0, 1))
                named[c] = "*" if c not in own else "*" + side[c] if len(like) > 1 and score(b, m, sb - b, sm - m) < z else c
            for name in set(named.values()):
                keys = [k for c, ks in branches.items() if named[c] == name for k in ks]
                b, m = total(keys)
                after |= {k: (f"{above}/{name}", (b + prior * state[k][1]) / (m + prior)) for k in keys}
        state = after
    return state


def test_tree_matches_branch_by_branch(spark):
    rng = random.Random(6)
    pages = [("h.org", "", 1), ("h.org", "", None), ("only.org", "x", None)]
    for _ in range(900):
        host = rng.choice(["a.com", "b.com"])
        path = [rng.choice(["news", "shop", "tag", "spam", "ads"]), rng.choice(["#", "old", "x#"]), rng.choice(["p", "q", "r", "s"])][: rng.randint(1, 3)]
        bad = rng.random() < (0.95 if path[0] in ("spam", "ads") else 0.5 if path[-1] == "q" else 0.05)
        pages.append((host, "/".join(path), int(bad) if rng.random() < 0.8 else None))
    got = template_tree(spark.createDataFrame(pages, "host string, shape string, bad int").repartition(3))
    want = plain_tree(pages)
    assert {(r.host, r.shape): r.template for r in got.collect()} == {k: t for k, (t, _) in want.items()}
    assert {(r.host, r.shape): r.purity for r in got.collect()} == pytest.approx({k: x for k, (_, x) in want.items()})
    assert len({t for t, _ in want.values()}) > 6 and any("*+" in t or "*-" in t for t, _ in want.values())


def test_variable_segments(spark):
    cases = {
        "/item/12/page-3.html": "item/#/page-#.html",
        "/u/3f2504e0-4f89-11d3-9a0c-0305e82c3301/x": "u/#/x",
        "/c/DEADBEEF01/deadbeef": "c/#/deadbeef",
        "/facade/accede": "facade/accede",
        "/watch/dQw4w9WgXcQ": "watch/#",
        "/watch/Documentation": "watch/Documentation",
        "/2020/Jan/05/a": "#/#/#/a",
        "/05-march-2021": "#-#-#",
        "/may/be/march": "may/be/march",
        "/news/the-quick-brown-fox.html": "news/~.html",
        "/news/a_b_c_d_e/": "news/~",
        "/terms-of-service": "terms-of-service",
        "/post/top-10-things-to-do": "post/~",
        "//a///b/": "a/b",
        "": "",
        "/" + "a-" * 50000 + "b": "~",
    }
    rows = spark.createDataFrame([(p, s) for p, s in cases.items()] + [(None, "")], "path string, want string")
    for r in rows.select("path", "want", shape(F.col("path")).alias("got")).collect():
        assert r.got == r.want, r.path[:80] if r.path else r


def test_titles_and_identifiers_share_a_template(spark):
    """Labelled pages tell of others that have the same form and no page in common with them."""
    rows = [(f"http://h.net/{kind}/{word}-{i}-of-the-{word}s", bad) for kind, bad in (("win", 1), ("read", 0)) for word in ("cat", "dog", "owl") for i in range(10)]
    rows += [("http://h.net/win/some-other-title-here", None), ("http://h.net/read/yet-another-long-title", None)]
    got = {r.url: r for r in judge_urls(spark.createDataFrame(rows, "url string, bad int"), rules=(), label="bad").collect()}
    assert got["http://h.net/win/some-other-title-here"]["_verdict"] == "block" and got["http://h.net/read/yet-another-long-title"]["_verdict"] == "allow"
    assert {r["_template"] for r in got.values()} == {"/win/~", "/read/~"}
