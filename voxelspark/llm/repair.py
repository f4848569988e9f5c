"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

The edits of a turn are a small weighted automaton over four states of the roles told so far. It is determinised lazily: the vector of the least costs to each state, less the least of them, is a state of the new automaton, made when a row first leads to it and kept in a transition table. A scan of that table gives the cost of a conversation; a trace backward over tight arcs, kept in a table of its own, gives the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Turns of white space only are blank; a turn that does not end in one of ENDS is truncated.
WHITE, ENDS = "\t\n\v\f\r ", ".!?"
#: What was told so far: nothing, the system's turn, a user's turn, an assistant's turn. The first and the last may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Symbols of a row: its role's initial (of INITIALS, or another) and its fault, as a digit 4 * initial + fault to the base 32; the row's copies have 16 more.
INITIALS = "sua"
FOLLOWS = {"su", "ua", "au"}
#: Edits as they are told to the rows: the audit's letter of each.
AUDIT = str.maketrans("kuaUAd", "KRRIID")
FAR = 1 << 40


class Repair:
    """The automaton, its determinised states and the two tables, which grow as rows ask for them.

    Costs to a state that can no longer be on a cheapest path are left out, so the vectors are few: from ASSISTANT everything can follow that follows SYSTEM, or NOTHING if the system's turn is deleted instead.
    """

    def __init__(self):
        self.arcs = [self._arcs(c, f) for c in range(4) for f in range(4)]
        self.inserts = [(p, USER, "U") for p in (NOTHING, SYSTEM, ASSISTANT)] + [(USER, ASSISTANT, "A")]
        self.vectors, self.ids, self.moves = [], {}, {}
        self.ranks, self.rank_ids, self.traces, self.ends = [], {}, {}, {}
        self.first, _ = self._state([0, FAR, FAR, FAR])

    @staticmethod
    def _arcs(initial: int, fault: int) -> list[tuple[int, int, int, str]]:
        """(from, to, cost, edit) of a row; giving a row the role that it has is dearer than keeping it."""
        out = [(p, p, DELETE, "d") for p in range(4)]
        if fault in (BLANK, DUPLICATE):
            return out
        more = CUT if fault == TRUNCATED else 0
        to_user = [(p, USER) for p in (NOTHING, SYSTEM, ASSISTANT)]
        kept = {0: [(NOTHING, SYSTEM)], 1: to_user, 2: [(USER, ASSISTANT)]}.get(initial, [])
        out += [(p, q, KEEP + more, "k") for p, q in kept]
        out += [(p, q, REROLE + more, "u") for p, q in to_user if initial != 1]
        return out + ([(USER, ASSISTANT, REROLE + more, "a")] if initial != 2 else [])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The id of the determinised state of a cost vector, and what was taken off it."""
        for _ in range(2):
            for p, q, _edit in self.inserts:
                costs[q] = min(costs[q], costs[p] + INSERT)
        if costs[NOTHING] > costs[ASSISTANT] + DELETE:
            costs[NOTHING] = FAR
        if costs[SYSTEM] > costs[ASSISTANT]:
            costs[SYSTEM] = FAR
        least = min(costs)
        vector = tuple(c - least if c < FAR else FAR for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, cost), from the table or made for it."""
        found = self.moves.get((state, symbol))
        if found is None:
            old, new = self.vectors[state], [FAR] * 4
            for p, q, cost, _edit in self.arcs[symbol]:
                new[q] = min(new[q], old[p] + cost)
            found = self.moves[state, symbol] = self._state(new)
        return found

    def _ranked(self, vector: tuple, found: dict) -> tuple[int, tuple]:
        """The id of the order of the states' edits from here on (lists of what is compared first), once insertions are tried, and each state's (edits, next state)."""
        for _ in range(3):
            for p, q, edit in self.inserts:
                if q in found and vector[p] < FAR and vector[q] == vector[p] + INSERT:
                    key, (edits, to) = found[q]
                    if p not in found or ("I", *key) < found[p][0]:
                        found[p] = ("I", *key), (edit + edits, to)
        order = {k: i for i, k in enumerate(sorted({key for key, _ in found.values()}))}
        ranks = tuple(order[found[p][0]] if p in found else -1 for p in range(4))
        if ranks not in self.rank_ids:
            self.rank_ids[ranks] = len(self.ranks)
            self.ranks.append(ranks)
        return self.rank_ids[ranks], tuple(found[p][1] if p in found else None for p in range(4))

    def end(self, state: int) -> tuple[int, tuple]:
        """What is left after the last row: the states that may end at the least cost, and those that an insertion brings there."""
        if state not in self.ends:
            v = self.vectors[state]
            least = min(v[NOTHING], v[ASSISTANT])
            self.ends[state] = self._ranked(v, {p: ((), ("", p)) for p in (NOTHING, ASSISTANT) if v[p] == least})
        return self.ends[state]

    def trace(self, state: int, symbol: int, rank: int) -> tuple[int, tuple]:
        """One row backward: of the tight arcs into states that are on a cheapest path, each state's least in the order of the audit."""
        found = self.traces.get((state, symbol, rank))
        if found is None:
            to, base = self.move(state, symbol)
            old, new, ranks, best = self.vectors[state], self.vectors[to], self.ranks[rank], {}
            for p, q, cost, edit in self.arcs[symbol]:
                if ranks[q] >= 0 and old[p] < FAR and old[p] + cost == new[q] + base:
                    key = edit.translate(AUDIT), ranks[q]
                    if p not in best or key < best[p][0]:
                        best[p] = key, (edit, q)
            found = self.traces[state, symbol, rank] = self._ranked(old, best)
        return found

    def edits(self, symbols: list[int]) -> tuple[int, list[str]]:
        """The least cost of a conversation's rows, and the edits of each row with the insertions before it (the last row's with those after it)."""
        state, cost, path = self.first, 0, []
        for s in symbols:
            path.append(state)
            state, more = self.move(state, s)
            cost += more
        cost += min(self.vectors[state][NOTHING], self.vectors[state][ASSISTANT])
        rank, choice = self.end(state)
        steps = [choice]
        for s, p in zip(reversed(symbols), reversed(path), strict=True):
            rank, choice = self.trace(p, s, rank)
            steps.append(choice)
        at, out = NOTHING, []
        for choice in reversed(steps):
            told, at = choice[at]
            out.append(told)
        last = out.pop()
        if out:
            out[-1] += last
        return cost, out


def _illegal(symbols: list[int]) -> int:
    names = [(INITIALS + "-")[s >> 2] for s in symbols]
    return sum(a + b not in FOLLOWS for a, b in zip(names, names[1:]))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults, cost, audit and the edits of each piece, of conversations with their pieces in order."""
    repair = Repair()
    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "told"]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("piece", pa.int32()), ("edits", pa.list_(pa.string()))]))]
    for batch in batches:
        out = []
        for key, pieces in zip(batch.column("key").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            digits = [int(c, 32) for p in pieces for c in p["symbols"]]
            symbols = [d & 15 for d in digits]
            turns = [p for p in pieces if p["low"] is not None]
            different = sum(p["turns"] for p in turns) - sum(a["high"] == b["low"] for a, b in zip(turns, turns[1:]))
            gaps = turns[-1]["high"] - turns[0]["low"] + 1 - different if turns else 0
            faults = [sum(s & 3 == f for s in symbols) for f in (BLANK, DUPLICATE, TRUNCATED)]
            cost, edits = repair.edits(symbols)
            told, at = [], 0
            for p in pieces:
                own: list[str] = []
                for d, e in zip(digits[at : at + len(p["symbols"])], edits[at:]):
                    if d < 16:
                        own.append(e)
                    else:  # a copy follows its row in the same piece
                        own[-1] += e
                told.append({"piece": p["piece"], "edits": own})
                at += len(p["symbols"])
            out.append((key, gaps, *faults, _illegal(symbols), cost, "".join(edits).translate(AUDIT), told))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's lines, which come in order: one conversation's hash is held at a time, never its text."""
    key = digest = None
    for batch in batches:
        done = []
        for k, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["key", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "sha"])


def faults(role: Column, text: Column, again: Column) -> Column:
    """The symbol of a row: its role's initial and its first fault; ``again`` says whether role and text were seen earlier."""
    end = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(end == "", BLANK).when(again, DUPLICATE).when(end.isin(*ENDS), FINE).otherwise(TRUNCATED)
    return F.lower(F.hex(place * 4 + fault))


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation: its audit and its repaired turns.

    The first table has a row for each conversation: key, conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit. The second has key, place (piece, at) and line, the repaired ``role:text`` of a row with those of the insertions beside it, newline-joined.

    Turns go by number (nulls first), then role, then text (its first 64 characters, then its digest). Null role and null text are one space. Rows that are alike are one row with a number of copies, which are duplicates; ``copies`` names a column with the number of times that a row counts, 0 for none, and a conversation without rows has an empty audit. Rows of null conv_id are one conversation. An empty table gives empty results; other columns are left out. A turn's text is handled in the JVM, however long.

    Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any share of the rows is split; of each piece goes on what its rows are called, one character a row, and the audit, which is one string a conversation as well, is found from these. Texts meet their edits by (conversation, role, digest), whose groups are copies and are aggregated before the shuffle.
    """
    spark = turns.sparkSession
    kind = turns.select(F.col(conv)).schema[0].dataType
    one = F.lit(1) if copies is None else F.col(copies)
    key = F.coalesce(F.concat(F.lit("+"), F.col(conv).cast("string")), F.lit("-"))
    rows = turns.select(key.alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), one.cast("long").alias("n"))
    digest = F.md5(F.encode("text", "UTF-8"))
    there = F.col("n") > 0
    slim = rows.select("key", F.when(there, F.col("turn")).alias("turn"), *(F.when(there, c).otherwise("").alias(n) for c, n in ((F.col("role"), "role"), (F.substring("text", 1, 64), "head"), (digest, "h"), (faults(F.col("role"), F.col("text"), F.lit(False)), "symbol"))), "n")
    slim = slim.groupBy("key", "turn", "role", "head", "h", "symbol").agg(F.sum("n").alias("n"))
    # The first turn of each role and text: nulls come first, and a conversation may have one role and text in many turns.
    early = F.struct(F.col("turn").isNotNull().alias("named"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = slim.groupBy("key", "role", "h").agg(F.min(early).alias("e"))
    marked = slim.withColumn("e", early).join(firsts.withColumn("first", F.lit(True)), ["key", "role", "h", "e"], "left").drop("e")
    own = F.conv("symbol", 16, 10).cast("int")
    again = F.when(own.bitwiseAND(F.lit(3)) == BLANK, own).otherwise(own.bitwiseOR(F.lit(DUPLICATE)))
    digit = lambda v: F.lower(F.conv(v.cast("string"), 10, 32))
    symbols = F.concat(digit(F.when(F.col("first"), own).otherwise(again)), F.repeat(digit(again + 16), (F.col("n") - 1).cast("int")))
    named = marked.select("key", "turn", "role", "head", "h", F.when(F.col("n") > 0, symbols).otherwise("").alias("symbols"))
    # Ranges depend on a sample, so the pieces are written once and read twice.
    dealt = named.repartitionByRange("key", "turn", "role", "head", "h").withColumn("piece", F.spark_partition_id())
    pieces = dealt.groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "head", "h", "symbols"))).alias("rows"))
    known = F.array_compact("rows.turn")
    lean = F.transform(F.filter("rows", lambda r: r["symbols"] != ""), lambda r: F.struct(r["role"].alias("role"), r["h"].alias("h")))
    pieces = stored(pieces.select("key", "piece", F.array_join("rows.symbols", "").alias("symbols"), F.array_min(known).alias("low"), F.array_max(known).alias("high"), F.size(F.array_distinct(known)).alias("turns"), lean.alias("rows")), "pieces")

    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "symbols", "low", "high", "turns"))).alias("pieces"))
    ddl = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, told array<struct<piece: int, edits: array<string>>>"
    audited = stored(whole.mapInArrow(_audited, ddl), "audits")

    told = audited.select("key", F.explode("told").alias("t")).select("key", "t.piece", "t.edits")
    met = pieces.select("key", "piece", "rows").join(told, ["key", "piece"])
    spread = met.select("key", "piece", F.posexplode(F.arrays_zip("rows", "edits")).alias("at", "r"))
    outs = spread.select("key", "piece", "at", F.col("r.rows.role").alias("role"), F.col("r.rows.h").alias("h"), F.replace(F.col("r.edits"), F.lit("d"), F.lit("")).alias("edit")).filter("edit <> ''")
    texts = rows.filter(there).select("key", "role", digest.alias("h"), "text").groupBy("key", "role", "h").agg(F.min("text").alias("text"))
    said = lambda c: F.when(c == "U", "user:").when(c == "A", "assistant:").when(c == "u", F.concat(F.lit("user:"), "text")).when(c == "a", F.concat(F.lit("assistant:"), "text")).otherwise(F.concat("role", F.lit(":"), "text"))
    lines = outs.join(texts, ["key", "role", "h"]).select("key", "piece", "at", F.array_join(F.transform(F.split("edit", ""), said), "\n").alias("line"))
    named_key = F.when(F.col("key") != "-", F.substr("key", F.lit(2))).cast(kind).alias("conv_id")
    return audited.drop("told").withColumn("conv_id", named_key), lines


def repaired_hashes(lines: DataFrame) -> DataFrame:
    """key and the SHA-256 of each conversation's repaired lines, newline-joined. A hash has to be fed in order, so a conversation's lines pass through one task, which holds none of them."""
    return lines.repartition("key").sortWithinPartitions("key", "piece", "at").mapInArrow(_hashed, "key string, sha string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with the damage of a test: by crc32(conv_id:turn) % 20, 0 drops a row (n is 0), 1 empties its text, 2 takes its full stops, marks of exclamation and of question, 3 repeats it (n is 2), and 4 sets its role to user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.encode(F.concat(word("conv_id"), F.lit(":"), word("turn")), "UTF-8")) % 20
    text = F.when(by == 1, "").when(by == 2, F.translate(word("text"), ENDS, "")).otherwise(word("text"))
    return turns.select("conv_id", "turn", F.when(by == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), F.when(by == 0, 0).when(by == 3, 2).otherwise(1).alias("n"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits, lines = repair_conversations(damaged(table(spark, sf_dir, "conversations")), copies="n")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = audits.join(repaired_hashes(lines), "key", "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", empty).alias("repaired_sha256"))


def _told(x: str, cost: str, edit: str, line: str | None = None) -> str:
    return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'r': {x}.r" + (f" || {line} || chr(10)}}" if line else "}")


def _least(*states: str) -> str:
    return f"list_sort([e FOR e IN [{', '.join(states)}] IF e IS NOT NULL])[1]"


def _when(test: str, state: str, value: str) -> str:
    return f"CASE WHEN {test} AND {state} IS NOT NULL THEN {value} END"


def _row_sql() -> str:
    """The four states after a row, as columns t0 to t3, from p0 to p3 before it."""
    more = f"CASE WHEN f = {TRUNCATED} THEN {CUT} ELSE 0 END"
    stays = f"f IN ({FINE}, {TRUNCATED})"
    gone = [_when("TRUE", f"p{i}", _told(f"p{i}", str(DELETE), "D")) for i in range(4)]
    kept = lambda i, initial: _when(f"{stays} AND initial = '{initial}'", f"p{i}", _told(f"p{i}", more, "K", "role || ':' || text"))
    reroled = lambda i, role: _when(f"{stays} AND initial <> '{role[0]}'", f"p{i}", _told(f"p{i}", f"{REROLE} + {more}", "R", f"'{role}:' || text"))
    user = _least(gone[2], *(kept(i, "u") for i in (0, 1, 3)), *(reroled(i, "user") for i in (0, 1, 3)))
    return f"{gone[0]} AS t0, {_least(gone[1], kept(0, 's'))} AS t1, {user} AS t2, {_least(gone[3], kept(2, 'a'), reroled(2, 'assistant'))} AS t3"


_user = _least("t2", *(_when("TRUE", f"t{i}", _told(f"t{i}", str(INSERT), "I", "'user:'")) for i in (0, 1, 3)))
_assistant = _least("t3", _when("TRUE", "p2", _told("p2", str(INSERT), "I", "'assistant:'")))


def _closed(source: str) -> str:
    return f"SELECT *, {_assistant} AS p3 FROM (SELECT * EXCLUDE (t2), {_user} AS p2 FROM ({source}))"


_start = "{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}"
OP12_SQL = f"""
WITH RECURSIVE w AS (
  SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS ck, coalesce(CAST(turn AS VARCHAR), ' ') AS tk, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
crc0 AS (SELECT DISTINCT ck || ':' || tk AS word FROM w),
crc1 AS (SELECT word, list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ord(c) AS BIGINT) FOR c IN string_split(word, '')],
  lambda h, b: xor(h >> 8, (list_reduce([xor(h, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))) AS h FROM crc0),
damage AS (SELECT word, xor(h, 4294967295) % 20 AS k FROM crc1),
after AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '{ENDS}', '') ELSE text END AS text, unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM w JOIN damage ON word = ck || ':' || tk),
placed AS (
  SELECT *, role[1] AS initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS mark,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM after),
r AS (SELECT conv_id, turn, role, text, initial, i, CASE WHEN mark = '' THEN {BLANK} WHEN again > 1 THEN {DUPLICATE} WHEN mark IN ('.', '!', '?') THEN {FINE} ELSE {TRUNCATED} END AS f, lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS then_ FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = {BLANK}) AS blank, count(*) FILTER (f = {DUPLICATE}) AS duplicate, count(*) FILTER (f = {TRUNCATED}) AS truncated,
    count(*) FILTER (then_ IS NOT NULL AND initial || then_ NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
none AS (SELECT CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS x),
walk AS (
  SELECT conv_id, i, p0, p1, p2, p3 FROM ({_closed(f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {_start} AS p0, x AS p1, {_start} AS t0, x AS t1, x AS t2, x AS t3 FROM counts, none")})
  UNION ALL
  SELECT conv_id, i, p0, p1, p2, p3 FROM ({_closed(f"SELECT *, t0 AS p0, t1 AS p1 FROM (SELECT walk.conv_id, r.i, {_row_sql()} FROM walk JOIN r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.i = walk.i + 1)")})),
done AS (SELECT walk.conv_id, {_least("p0", "p3")} AS x FROM walk JOIN counts c ON c.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = c.n)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.r[1:length(x.r) - 1], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM k.conv_id
"""
