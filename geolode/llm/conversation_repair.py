"""Conversation structure repair as a shortest path through composed weighted automata.

Three machines are composed lazily, arc by arc, as states are reached: the input acceptor (one arc a row, labelled by the role's initial and the row's fault), the edit
transducer (Keep, Rerole, Delete consume a row, Insert consumes none; at most two inserts in a row, which is all that the grammar can use, and makes the whole
acyclic) and the acceptor of the role grammar ``(s?(ua)+)?``. Weights are (cost, edits as a string) in lexicographic order; their sum is the minimum, their product adds and
appends. Two paths to one state have consumed equally many rows, so neither string is a true prefix of the other, and appending keeps their order: the shortest path in topological order
is exact, and so is the product of blocks.

A conversation is handled in blocks of bounded size (as ``chat_format.blocks`` makes them). One of a single block is repaired where the block is. For longer ones each block becomes a
matrix of weights between grammar states, the matrices of a conversation are multiplied in order (with ranks in place of long strings), and each block then gets its own part of the edits. So
a conversation with a third of all rows is work for many tasks; only its matrices, and in ``summary`` its digest, meet in one. Duplicates of rows in earlier blocks are found by digests.

Rows are ordered by turn (nulls first), then role and text. Null role or text is one space, so such a text is blank; a role that begins with none of s, u, a can't be kept. Rows with a
null conv_id form one conversation. Repeated rows are duplicates. An empty table gives no rows, and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm import chat_format
from geolode.llm.common import few, saved, small_side, written
from geolode.llm.importance import CRC_TABLE, crc_sql

SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Cost of each edit, and of a truncated row that stays.
COSTS, STAYS_TRUNCATED, INSERTS = {"K": 0, "R": 1, "D": 2, "I": 5}, 5, 2
#: The grammar's acceptor: state and initial to state; where it may end.
GRAMMAR = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
FINAL = ("0", "A")
#: Roles that Rerole and Insert can give.
GIVEN = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

Weight = tuple[int, str]


@cache
def given(state: str) -> tuple[str, str]:
    """The one role that Rerole or Insert can give in a state of the grammar, and the state that it leads to."""
    return next((role, GRAMMAR[state, first]) for first, role in GIVEN.items() if (state, first) in GRAMMAR)


@cache
def consuming(initial: str, fault: int, state: str) -> tuple[tuple[str, int, str], ...]:
    """Composed arcs that consume a row: edit, cost, state of the grammar."""
    arcs = [("D", COSTS["D"], state)]
    if fault not in (BLANK, DUPLICATE):
        more = STAYS_TRUNCATED if fault == TRUNCATED else 0
        arcs.append(("R", COSTS["R"] + more, given(state)[1]))
        if (state, initial) in GRAMMAR:
            arcs.append(("K", COSTS["K"] + more, GRAMMAR[state, initial]))
    return tuple(arcs)


def inserted(best: dict[str, Weight]) -> list[tuple[str, Weight]]:
    """The states of best and those that up to INSERTS inserts lead to from there."""
    found, front = list(best.items()), list(best.items())
    for _ in range(INSERTS):
        front = [(given(q)[1], (cost + COSTS["I"], edits + "I")) for q, (cost, edits) in front]
        found += front
    return found


def shortest(rows: list[tuple[str, int]], start: str) -> dict[str, Weight]:
    """The least weight from start to each state of the grammar behind the last row; rows are (initial, fault)."""
    best: dict[str, Weight] = {start: (0, "")}
    for initial, fault in rows:
        following: dict[str, Weight] = {}
        for state, (cost, edits) in inserted(best):
            for edit, more, to in consuming(initial, fault, state):
                weight = (cost + more, edits + edit)
                if to not in following or weight < following[to]:
                    following[to] = weight
        best = following
    return best


def closed(best: dict[str, Weight]) -> Weight:
    """The least weight to an end of the grammar."""
    return min(weight for state, weight in inserted(best) if state in FINAL)


def faults(turns: list[dict], known: set[int]) -> list[int]:
    """The first fault of each row; known are places of rows that stood in earlier blocks."""
    found, seen = [], set()
    for place, t in enumerate(turns):
        text, same = t["text"].rstrip(SPACES), (t["role"], t["text"])
        found.append(BLANK if not text else DUPLICATE if same in seen or place in known else TRUNCATED if text[-1] not in STOPS else SOUND)
        seen.add(same)
    return found


def applied(turns: list[dict], edits: str, state: str) -> list[dict]:
    """The turns that edits leave; inserted ones have no turn number."""
    out, rows = [], iter(turns)
    for edit in edits:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        role, to = given(state)
        if edit == "K":
            role, to = row["role"], GRAMMAR[state, row["role"][:1]]
        out.append({"turn": row and row["turn"], "role": role, "text": row["text"] if row else "", "edit": edit})
        state = to
    return out


class Seen:
    """What counts of rows in order, a block after another."""

    def __init__(self) -> None:
        self.counts, self.illegal, self.distinct = [0] * 4, 0, 0
        self.least = self.most = self.last = self.initial = None

    def add(self, counts: list[int], illegal: int, turns: tuple[int | None, int | None, int], initials: tuple[str, str]) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.illegal += illegal + (self.initial is not None and self.initial + initials[0] not in LEGAL)
        self.initial = initials[1]
        low, high, distinct = turns
        if distinct:
            self.distinct += distinct - (low == self.most)
            self.least, self.most = low if self.least is None else self.least, high

    def values(self) -> dict[str, int]:
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED], "illegal": self.illegal}


def block_counts(turns: list[dict], found: list[int]) -> dict:
    initials, numbers = [t["role"][:1] for t in turns], [t["turn"] for t in turns if t["turn"] is not None]
    return {
        "counts": [found.count(k) for k in range(4)],
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "turns": (min(numbers, default=None), max(numbers, default=None), len(set(numbers))),
        "initials": (initials[0], initials[-1]),
    }


def product(matrices: list[dict[str, dict[str, Weight]]]) -> list[tuple[str, int, str]]:
    """State before, cost and edits of every block on the shortest path through all of them.

    Of each state the rank of its edits among those of all states stands for them, so no long string is built: where ranks differ, the strings differ before either ends.
    """
    best, back = {"0": (0, 0)}, []
    for matrix in matrices:
        found: dict[str, tuple] = {}
        for before, (cost, rank) in best.items():
            for to, (more, edits) in matrix[before].items():
                weight = (cost + more, rank, edits, before)
                if to not in found or weight < found[to]:
                    found[to] = weight
        order = sorted(found, key=lambda q: found[q][1:3])
        back.append(found)
        best = {q: (found[q][0], order.index(q)) for q in found}
    ends = []
    for state, (cost, rank) in best.items():
        for to, (more, edits) in inserted({state: (0, "")}):
            if to in FINAL:
                ends.append((cost + more, rank, edits, state, more))
    _, _, tail, state, tail_cost = min(ends)
    out = []
    for found, matrix in zip(reversed(back), reversed(matrices), strict=True):
        _, _, edits, before = found[state]
        out.append((before, matrix[before][state][0] + tail_cost, edits + tail))
        state, tail, tail_cost = before, "", 0
    return out[::-1]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_KEY = ("conv", "none", "block")
_TURN = "struct<turn:bigint,role:string,text:string,edit:string>"
_REPAIRED = f"conv bigint, none boolean, block struct<number:bigint,cut:bigint>, {', '.join(f'{c} bigint' for c in _COUNTS)}, cost bigint, audit string, repaired array<{_TURN}>"


def _mapped(df: DataFrame, schema: str, make) -> DataFrame:
    """make(row) of each row as a row of schema; None leaves it out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 64):
            rows = [out for row in batch.to_pylist() for out in make(row)]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, schema)


def _single(row: dict) -> list[dict]:
    turns = row["turns"]
    found, seen = faults(turns, set()), Seen()
    seen.add(**block_counts(turns, found))
    cost, audit = closed(shortest([(t["role"][:1], f) for t, f in zip(turns, found, strict=True)], "0"))
    return [{**{k: row[k] for k in _KEY}, **seen.values(), "cost": cost, "audit": audit, "repaired": applied(turns, audit, "0")}]


_CELL = "struct<before:string,after:string,cost:bigint,audit:string>"
_MATRIX = f"conv bigint, none boolean, block struct<number:bigint,cut:bigint>, cells array<{_CELL}>, counts array<bigint>, illegal bigint, low bigint, high bigint, distinct bigint, first string, last string"


def _matrix(row: dict) -> list[dict]:
    turns = row["turns"]
    found = faults(turns, set(row["known"] or ()))
    rows = [(t["role"][:1], f) for t, f in zip(turns, found, strict=True)]
    cells = [{"before": a, "after": b, "cost": w[0], "audit": w[1]} for a in "0SUA" for b, w in shortest(rows, a).items()]
    c = block_counts(turns, found)
    low, high, distinct = c["turns"]
    return [{**{k: row[k] for k in _KEY}, "cells": cells, "counts": c["counts"], "illegal": c["illegal"], "low": low, "high": high, "distinct": distinct, "first": c["initials"][0], "last": c["initials"][1]}]


_PART = f"conv bigint, none boolean, block struct<number:bigint,cut:bigint>, {', '.join(f'{c} bigint' for c in _COUNTS)}, cost bigint, audit string, before string"


def _parts(row: dict) -> list[dict]:
    seen, matrices = Seen(), []
    for b in row["blocks"]:
        seen.add(b["counts"], b["illegal"], (b["low"], b["high"], b["distinct"]), (b["first"], b["last"]))
        matrix: dict[str, dict[str, Weight]] = {q: {} for q in "0SUA"}
        for c in b["cells"]:
            matrix[c["before"]][c["after"]] = (c["cost"], c["audit"])
        matrices.append(matrix)
    counts, none = seen.values(), dict.fromkeys(_COUNTS, 0)
    parts = zip(row["blocks"], product(matrices), strict=True)
    return [{"conv": row["conv"], "none": row["none"], "block": b["block"], **(none if k else counts), "cost": cost, "audit": audit, "before": before} for k, (b, (before, cost, audit)) in enumerate(parts)]


def _applied(row: dict) -> list[dict]:
    return [{**{k: row[k] for k in (*_KEY, *_COUNTS, "cost", "audit")}, "repaired": applied(row["turns"], row["audit"], row["before"])}]


def _known(pieces: DataFrame) -> DataFrame:
    """Of each block the places of rows whose role and text stood in an earlier block of the conversation."""
    rows = pieces.select(*_KEY, F.posexplode("turns").alias("place", "t"))
    digest = F.unhex(F.sha2(F.concat(F.length("t.role").cast("string"), F.lit(":"), F.col("t.role"), F.col("t.text")), 256))
    rows = saved(rows.select(*_KEY, "place", digest.alias("digest")))
    first = rows.groupBy("conv", "none", "digest").agg(F.min("block").alias("first"), F.max("block").alias("last")).filter(F.col("first") < F.col("last")).drop("last")
    return rows.join(first, ["conv", "none", "digest"]).filter(F.col("block") > F.col("first")).groupBy(*_KEY).agg(F.collect_list("place").alias("known"))


def _repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Repaired blocks of conversations of one block, and of the others: key, counts (of a conversation at its first block), cost and audit of the block, repaired."""
    space = F.lit(" ")
    filled = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    pieces = written(chat_format.blocks(filled).select(*_KEY, "turns"))
    long = saved(pieces.groupBy("conv", "none").agg(F.count("*").alias("n")).filter("n > 1").select("conv", "none"))
    n = long.count()
    if not n:
        return _mapped(pieces, _REPAIRED, _single), None
    side = small_side(long, n, 16)
    single, several = pieces.join(side, ["conv", "none"], "left_anti"), pieces.join(side, ["conv", "none"], "left_semi")
    matrices = _mapped(several.join(_known(several), list(_KEY), "left"), _MATRIX, _matrix)
    blocks = matrices.groupBy("conv", "none").agg(F.sort_array(F.collect_list(F.struct("block", *[c for c in matrices.columns if c not in _KEY]))).alias("blocks"))
    parts = saved(_mapped(blocks, _PART, _parts))
    return _mapped(single, _REPAIRED, _single), _mapped(several.join(parts, list(_KEY)), _REPAIRED, _applied)


def _conv_id() -> Column:
    return F.when(~F.col("none"), F.col("conv")).alias("conv_id")


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, block and place (their order), turn (null: inserted), role, text and edit (K, R or I)."""
    single, several = _repaired(turns)
    whole = single if several is None else single.unionByName(several)
    return whole.select(_conv_id(), "block", F.posexplode("repaired").alias("place", "t")).select("conv_id", "block", "place", "t.*")


def summary(turns: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    single, several = _repaired(turns)
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = single.select(_conv_id(), *_COUNTS, "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
    if several is None:
        return out
    part = F.struct("block", "audit", F.when(F.size("repaired") > 0, said).alias("said"))
    whole = several.groupBy("conv", "none").agg(*[F.sum(c).cast("long").alias(c) for c in (*_COUNTS, "cost")], F.sort_array(F.collect_list(part)).alias("parts"))
    return out.unionByName(whole.select(_conv_id(), *_COUNTS, "cost", F.array_join("parts.audit", "").alias("audit"), F.sha2(F.array_join("parts.said", "\n"), 256).alias("repaired_sha256")))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults put in by a hash of conv_id and turn: one of twenty each dropped, emptied, robbed of its stops, repeated, or of role user."""
    of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """summary of damaged turns, with a row for each conv_id of turns; those that lost all rows have zeros and the digest of nothing."""
    found = summary(damaged(turns)).withColumnRenamed("conv_id", "conv")
    every = turns.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*_COUNTS, "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_SPACE = r"[\x20\x09-\x0D]"
ORACLE_SQL = rf"""
WITH RECURSIVE crc AS {CRC_TABLE},
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM b WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS first, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?]{_SPACE}*$') THEN 'truncated' ELSE 'sound' END AS fault
  FROM o),
s AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
g(q, r, t) AS (VALUES ('0', 's', 'S'), ('0', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
v AS (SELECT q, CASE r WHEN 'u' THEN 'user' ELSE 'assistant' END AS role, t FROM g WHERE r <> 's'),
ins AS (
  SELECT q, q AS t, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM (VALUES ('0'), ('S'), ('U'), ('A')) z(q)
  UNION ALL SELECT q, t, 5, 'I', [role || ':'] FROM v
  UNION ALL SELECT v.q, w.t, 10, 'II', [v.role || ':', w.role || ':'] FROM v JOIN v w ON v.t = w.q),
arcs AS (
  SELECT conv_id, i, z.q, z.q AS t, 2 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS said FROM f, (VALUES ('0'), ('S'), ('U'), ('A')) z(q)
  UNION ALL SELECT conv_id, i, g.q, g.t, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM f JOIN g ON f.first = g.r WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, v.q, v.t, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [v.role || ':' || text] FROM f, v WHERE fault NOT IN ('blank', 'duplicate')),
steps AS (
  SELECT a.conv_id, a.i, ins.q, a.t, ins.cost + a.cost AS cost, ins.audit || a.audit AS audit, list_concat(ins.said, a.said) AS said FROM ins JOIN arcs a ON ins.t = a.q),
p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS q, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS w FROM s
  UNION ALL
  SELECT p.conv_id, p.i + 1, x.t, min({{'cost': p.w.cost + x.cost, 'audit': p.w.audit || x.audit, 'said': list_concat(p.w.said, x.said)}})
  FROM p JOIN steps x ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = p.i + 1 AND x.q = p.q GROUP BY p.conv_id, p.i, x.t),
e AS (
  SELECT p.conv_id, min({{'cost': p.w.cost + ins.cost, 'audit': p.w.audit || ins.audit, 'said': list_concat(p.w.said, ins.said)}}) AS w
  FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.n JOIN ins ON p.q = ins.q WHERE ins.t IN ('0', 'A') GROUP BY p.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.w.cost, 0) AS BIGINT) AS cost,
       coalesce(e.w.audit, '') AS audit, sha256(coalesce(array_to_string(e.w.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
