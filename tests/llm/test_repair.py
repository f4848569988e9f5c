"""The repair against a search through all edits, and rows that are odd."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from voxelspark.llm import repair

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip("\t\n\v\f\r ")[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "fine" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


def searched(rows, most=1):
    """(cost, audit, lines) by trying all edits of all rows with up to ``most`` insertions at every place."""
    kinds, best = faults(rows), None
    inserts = [c for n in range(most + 1) for c in itertools.product(("user", "assistant"), repeat=n)]
    edits = [["D"] if k in ("blank", "duplicate") else ["D", "K", "user", "assistant"] for k in kinds]
    for told in itertools.product(*edits):
        for ins in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i, before in enumerate(ins):
                cost, audit = cost + 5 * len(before), audit + "I" * len(before)
                lines += [(r, "") for r in before]
                if i < len(rows):
                    role, text = rows[i]
                    if told[i] == "D":
                        cost, audit = cost + 2, audit + "D"
                    else:
                        cost, audit = cost + (told[i] != "K") + 5 * (kinds[i] == "truncated"), audit + ("K" if told[i] == "K" else "R")
                        lines.append((role if told[i] == "K" else told[i], text))
            if (best is None or (cost, audit) < best[:2]) and GOOD.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)
    return best


def expected(rows):
    """Columns of a conversation's (turn, role, text), nulls included."""
    space = lambda v: " " if v is None else v
    rows = sorted(((t is not None, t or 0, space(r), space(x)) for t, r, x in rows))
    plain = [(r, x) for _, _, r, x in rows]
    turns, kinds, names = [t for n, t, _, _ in rows if n], faults(plain), [r[:1] or "-" for r, _ in plain]
    cost, audit, lines = searched(plain)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(names, names[1:])), cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def told(spark, rows):
    audits, lines = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = audits.join(repair.repaired_hashes(lines), "key", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha or empty) for r in got}


def test_equals_a_search_through_all_edits(spark):
    rng, rows = random.Random(5), []
    for c in range(60):
        for _ in range(rng.randrange(1, 5)):
            rows.append((c if c else None, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), rng.choice(["a.", "b?", "c!  \n", "cut", "", " ", None, "ü…"])))
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(tuple(row))
    assert told(spark, rows) == {c: expected(r) for c, r in by.items()}


def test_long_conversation_in_many_pieces(spark):
    """One conversation of nearly all rows, with one text in a third of its turns, against the plain automaton over its rows in order."""
    rows = [(7, t, ("user", "assistant")[t % 2], "same." if t % 3 == 0 else f"said {t}.") for t in range(3000)] + [(8, 0, "user", "x" * 3_000_000), (8, 1, "assistant", "y.")]
    got = told(spark, rows)
    plain = [(r, x) for _, _, r, x in rows[:3000]]
    names = {"fine": 0, "truncated": 1, "blank": 2, "duplicate": 3}
    machine = repair.Repair()
    cost, edits = machine.edits([4 * "sua".index(r[0]) + names[k] for (r, _), k in zip(plain, faults(plain), strict=True)])
    lines = [f"{'user' if e == 'U' else 'assistant'}:" if e in "UA" else f"{ {'k': r, 'u': 'user', 'a': 'assistant'}[e]}:{x}" for (r, x), es in zip(plain, edits, strict=True) for e in es if e != "d"]
    assert got[7][5:] == (cost, "".join(edits).translate(repair.AUDIT), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert got[7][2] == 998 and len(machine.vectors) < 100
    assert got[8][5:7] == (4, "DD")


def test_repeated_rows_are_duplicates(spark):
    rows = [(1, 0, "user", "a.")] * 500 + [(1, 1, "assistant", "b.")]
    gaps, blank, duplicate, truncated, illegal, cost, audit, _ = told(spark, rows)[1]
    assert (gaps, blank, duplicate, truncated, illegal, cost, audit) == (0, 0, 499, 0, 499, 998, "K" + "D" * 499 + "K")


def test_empty_table(spark):
    audits, lines = repair.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert audits.count() == 0 and repair.repaired_hashes(lines).count() == 0


def test_query_equals_oracle_with_nulls(spark, tmp_path):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(200)]), rng.choice(["system", "user", "assistant", "assistant", None]), rng.choice(["a.", "b?", "cut", "", None]) if rng.random() < 0.4 else f"text {rng.random()}{rng.choice(['.', '!', ' ', ''])}") for _ in range(300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r.asDict().values()) for r in repair.op12_repair(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(repair.OP12_SQL)
    names = [d[0] for d in want.description]
    assert names == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got == set(want.fetchall())


@pytest.mark.parametrize("faulty", [[], [0], [2, 3]])
def test_rows_without_a_repair_leave_nothing(faulty):
    cost, edits = repair.Repair().edits(faulty)
    assert (cost, "".join(edits)) == (2 * len(faulty), "d" * len(faulty))
