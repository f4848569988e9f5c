"""URL filters: listed rules first, then a path-template tree.

Each host has a tree of path segments. Variable segments are generalised (identifiers, dates and runs of digits become "#", titles "~"), sibling branches whose labelled rates do not differ significantly from the rest of their node are merged into the wildcard "*", and a template is rejected if its labelled purity, smoothed towards the template above it, reaches a threshold.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, shielded, table, unshielded

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Levels of the tree that every shape has; from there on, only nodes that hold labelled pages of both kinds are split, and segments below others are the one wildcard "**".
DEPTH = 8
#: Weight, in labelled pages, of what the template above says.
PRIOR = 2.0
#: Purity from which a template is rejected, and the z score from which a branch is its own.
PURITY, Z = 0.8, 2.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting rule, null where none fits. Rules are configuration: host, then path from the first slash on."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    empty = F.lit(None).cast("string")
    return (empty, empty) if rule is None else (rule, verdict)


#: What varies from page to page, in this order: UUIDs; hexadecimal numbers of eight digits or more, one of them below ten; whole segments of ten characters or more that have upper case, lower case and digits; months by name after or before a number; runs of digits; and whole segments, but for their endings, of four words or more joined by "-" or "_". No group repeats without a bound, as the JVM's expressions go one call deeper for each repetition, which a long path would not survive.
VARIABLE = (
    (r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])", "#"),
    (r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{8,}(?![0-9A-Za-z])", "#"),
    (r"(?<=/)(?=[^/]*[0-9])(?=[^/]*[a-z])(?=[^/]*[A-Z])[0-9A-Za-z_-]{10,}(?=/|$)", "#"),
    (r"(?i)(?<=[0-9][/_-])(?:jan|feb|mar|apr|may|june?|july?|aug|sept?|oct|nov|dec|january|february|march|april|august|september|october|november|december)(?=[/_-]|$)|(?<![^/_-])(?:jan|feb|mar|apr|may|june?|july?|aug|sept?|oct|nov|dec|january|february|march|april|august|september|october|november|december)(?=[/_-][0-9])", "#"),
    (r"[0-9]+", "#"),
    (r"(?<=/)(?:[^/._-]+[_-]){3}[^/._-][^/.]*", "~"),
)


def shape(path: Column) -> Column:
    """The path with what is ``VARIABLE`` as "#" or "~" and without empty segments."""
    for pattern, sign in VARIABLE:
        path = F.regexp_replace(path, pattern, sign)
    return F.concat_ws("/", F.filter(F.split(path, "/"), lambda s: s != ""))


def _score(b: Column, m: Column, rb: Column, rm: Column) -> Column:
    """Two-proportion z score of b of m against rb of rm, each with one more page of either kind."""
    pooled = (b + rb + 1) / (m + rm + 2)
    return F.abs((b + 1) / (m + 2) - (rb + 1) / (rm + 2)) / F.sqrt(pooled * (1 - pooled) * (1 / (m + 2) + 1 / (rm + 2)))


def template_tree(labelled: DataFrame, depth: int = DEPTH, prior: float = PRIOR, z: float = Z) -> DataFrame:
    """Templates of all (host, shape): columns host, shape, template, purity.

    ``labelled`` has host, shape and bad (1, 0, or null for unlabelled pages). The tree works on the distinct shapes with their counts, so a host with any share of the pages is a few rows here. A branch whose rate of bad pages does not differ from that of its siblings by a two-proportion z score of at least ``z`` shares "*". Of the others, those above and those below their siblings are compared among themselves: the ones alike share "*+" or "*-", the rest keep their own names. From level ``depth`` on, only nodes with pages of both labels are split. Purity is (bad + prior * purity above) / (labelled + prior), one half above the root.
    """
    known = labelled.groupBy("host", "shape").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("_b"), F.count("bad").cast("double").alias("_m"))
    cur = checkpoint(known.withColumns({"_s": F.filter(F.split("shape", "/"), lambda s: s != ""), "template": F.lit("")}))
    deepest = cur.agg(F.max(F.size("_s"))).first()[0] or 0
    roots = cur.groupBy("host").agg(F.sum("_b").alias("_B"), F.sum("_m").alias("_M"))
    roots = roots.select("host", ((F.col("_B") + prior * 0.5) / (F.col("_M") + prior)).alias("purity"))
    cur = cur.join(roots, "host")
    d = 0
    while d < deepest:
        if d >= depth - 1:
            both = cur.filter(F.size("_s") > d).groupBy("host", "template").agg(((F.sum("_b") > 0) & (F.sum("_b") < F.sum("_m"))).alias("_both"))
            folded = F.when((F.size("_s") > d + 1) & ~F.col("_both"), F.concat(F.slice("_s", 1, d), F.array(F.lit("**")))).otherwise(F.col("_s"))
            cur = cur.join(both, ["host", "template"], "left").withColumn("_s", folded).drop("_both")
            deepest = cur.agg(F.max(F.size("_s"))).first()[0]
        here = cur.withColumn("_c", F.get("_s", F.lit(d)))
        children = here.filter("_c is not null").groupBy("host", "template", "_c").agg(F.sum("_b").alias("_cb"), F.sum("_m").alias("_cm"))
        nodes = children.groupBy("host", "template").agg(F.sum("_cb").alias("_nb"), F.sum("_cm").alias("_nm"))
        b, m, rb, rm = F.col("_cb"), F.col("_cm"), F.col("_nb") - F.col("_cb"), F.col("_nm") - F.col("_cm")
        compared = children.join(nodes, ["host", "template"]).withColumns({"_own": _score(b, m, rb, rm) >= z, "_side": F.when((b + 1) / (m + 2) > (rb + 1) / (rm + 2), "+").otherwise("-")})
        sides = compared.filter("_own").groupBy("host", "template", "_side").agg(F.sum("_cb").alias("_sb"), F.sum("_cm").alias("_sm"), F.count("*").alias("_k"))
        sides = sides.withColumn("_own", F.lit(True))
        like = (F.col("_k") > 1) & (_score(b, m, F.col("_sb") - b, F.col("_sm") - m) < z)
        name = F.when(~F.col("_own"), F.lit("*")).when(like, F.concat(F.lit("*"), "_side")).otherwise(F.col("_c"))
        branches = compared.join(sides, ["host", "template", "_side", "_own"], "left").select("host", "template", "_c", name.alias("_t"))
        here = here.join(branches, ["host", "template", "_c"], "left")
        here = here.withColumn("_t", F.when(F.col("_c").isNotNull(), F.concat("template", F.lit("/"), "_t")))
        pure = here.filter("_t is not null").groupBy("host", "_t").agg(F.sum("_b").alias("_tb"), F.sum("_m").alias("_tm"))
        here = here.join(pure, ["host", "_t"], "left")
        deeper = F.col("_t").isNotNull()
        purity = F.when(deeper, (F.col("_tb") + prior * F.col("purity")) / (F.col("_tm") + prior)).otherwise(F.col("purity"))
        cur = checkpoint(here.select("host", "shape", "_b", "_m", "_s", F.when(deeper, F.col("_t")).otherwise(F.col("template")).alias("template"), purity.alias("purity")))
        d += 1
    return cur.select("host", "shape", "template", "purity")


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", label: str | None = None, purity: float = PURITY, **tree) -> DataFrame:
    """All rows of ``pages`` with _host, _path, _rule, _verdict, _template and _purity.

    Pages are labelled by ``label`` (1 bad, 0 good, null unknown), or else by the rule that fits them. Where no rule fits, a page is blocked if its template's purity is at least ``purity``. Null urls and urls without "://" have empty host and path, and the template "" of the empty host. Unlabelled hosts stay at one half and are allowed. Repeated rows are judged alike and stay repeated; an empty table gives an empty result; other columns are kept, whatever their names; those with the names of the six are replaced.
    """
    pages, old, (url, label) = shielded(pages, url, label)
    host, path = host_path(F.col(url))
    rule, verdict = rule_columns(F.col("_host"), F.col("_path"), rules)
    judged = pages.withColumns({"_host": host, "_path": path}).withColumns({"_rule": rule, "_said": verdict, "_shape": shape(F.col("_path"))})
    bad = F.col(label) if label else F.when(F.col("_said") == "block", 1).when(F.col("_said") == "allow", 0)
    templates = template_tree(judged.select(F.col("_host").alias("host"), F.col("_shape").alias("shape"), bad.alias("bad")), **tree)
    templates = templates.select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), F.col("template").alias("_template"), F.col("purity").alias("_purity"))
    joined = judged.join(templates, ["_host", "_shape"], "left")
    by_tree = F.when(F.col("_purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return unshielded(joined.withColumn("_verdict", F.coalesce("_said", by_tree)).drop("_said", "_shape"), old)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"), F.col("_template").alias("template"))
