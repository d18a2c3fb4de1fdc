"""Line dedup by a log-template tree, with built-in expressions only.

A line falls through a tree of fixed depth: number of tokens, then the leading tokens. Tokens with a digit are fields and
count as ``<*>`` everywhere. A leaf holds several templates, which further levels of the tree tell apart. In a group of a leaf's
distinct lines, a position behind the leading tokens is constant if one token stands there in more than half of them. If enough of these positions
are constant, that is a template, and the lines that have all its constants belong to it; the rest of the group goes on to the next level. Otherwise the
group is split at two neighbouring positions (without constants, if there are such), those whose pairs of tokens have the largest sum of squared counts: each pair that several lines have begins a group of the next level,
however few they are beside the group, and the lines whose pair is their own form one more. Pairs tell templates apart where single tokens of a varying field repeat by chance. Levels go on until
nothing is left to split, ``LEVELS`` at most. Lines that no template has taken in the end are templates of their own. A template that
occurs in ``LEAST_DOCS`` or more different texts is recurring; its lines stay in the text that has it first (by doc_id, and
in exact copies of that text) and are dropped elsewhere.

Leaves are counted on hashes alone, and only lines of leaves that several texts share are looked at word by word, each distinct line once.
Counts are pre-aggregated, so a line that stands in a third of all documents is a few rows in each task; joins back to the
lines are on hashes, and adaptive execution splits their hot keys.

Exact copies of a text count once and keep or lose the same lines. Blank lines and lines of fewer than ``LEAST_TOKENS``
tokens are never dropped. Null text counts as empty and stays null. Rows with null doc_id come before all others.
Repeated rows are copies; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import saved, small_side

#: Leading tokens of the tree; texts that make a template recurring; tokens of a line that may be dropped.
DEPTH, LEAST_DOCS, LEAST_TOKENS = 3, 3, 3
#: Constant tokens behind the leading ones that make a template: at least so many, and so many tenths of the tokens there.
CONSTANT, CONSTANT_TENTHS = 2, 6
#: Levels of the tree below the leading tokens at most; two find templates that differ at two neighbouring constants.
LEVELS = 5
FIELD = "<*>"


def _masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, copy (hash of the text), i, line, n, leaf and full (hash of the masked line) of every line that may be dropped."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("doc_id", F.xxhash64(whole).alias("copy"), F.posexplode(F.split(whole, "\n")).alias("i", "line"))
    df = df.withColumn("line", F.trim("line")).withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    df = df.filter((F.col("line") != "") & (F.col("n") >= LEAST_TOKENS))
    return df.withColumns({"leaf": F.xxhash64("n", _masked(F.substring_index("line", " ", DEPTH))), "full": F.xxhash64(_masked(F.col("line")))})


def _counts(lines: DataFrame) -> DataFrame:
    """grp, kind, at, token, c: how many lines of a group have a token at a position (kind 0), a pair of neighbouring tokens there (1), or so many tokens (2, under token); tokens of one line are left out."""
    cell = lambda kind, at, token: F.struct(F.lit(kind).alias("kind"), at.alias("at"), token.cast("long").alias("token"))
    w, size = F.col("w"), F.size("w")
    single = F.transform(w, lambda x, i: cell(0, i, x))
    pairs = F.when(size > 1, F.transform(F.sequence(F.lit(0), size - 2), lambda i: cell(1, i, F.xxhash64(w[i], w[i + 1])))).otherwise(F.slice(single, 1, 0))
    cells = lines.select("grp", F.explode(F.concat(single, pairs, F.array(cell(2, F.lit(0), size)))).alias("x")).select("grp", "x.*")
    return cells.groupBy("grp", "kind", "at", "token").agg(F.count("*").alias("c")).filter("c > 1 OR kind = 2")


def _shapes(counts: DataFrame) -> DataFrame:
    """grp, constants, split (position; null: none) and general of the groups of several lines."""
    total = counts.filter("kind = 2").groupBy("grp").agg(F.sum("c").alias("n"), F.max("token").alias("m")).filter("n > 1")
    places = counts.filter("kind < 2").groupBy("grp", "at").agg(
        F.max(F.when(F.col("kind") == 0, F.struct("c", "token"))).alias("top"), F.max(F.when(F.col("kind") == 1, F.col("c"))).alias("pair"), F.sum(F.when(F.col("kind") == 1, F.col("c") * F.col("c"))).alias("weight")
    )
    places = places.join(total, "grp").groupBy("grp").agg(
        F.first("m").alias("m"),
        F.collect_list(F.when(2 * F.col("top.c") > F.col("n"), F.struct("at", F.col("top.token").alias("word")))).alias("constants"),
        F.collect_list(F.when(2 * F.col("pair") <= F.col("n"), F.struct("weight", "at"))).alias("places"),
    )
    # pairs beside a constant say no more than one token, so they come last
    held = lambda at: F.exists("constants", lambda x: x["at"] == at)
    best = F.array_max(F.transform("places", lambda p: F.struct((~held(p["at"]) & ~held(p["at"] + 1)).alias("free"), p["weight"].alias("weight"), (-p["at"]).alias("before"))))
    size = F.size("constants")
    general = (size >= CONSTANT) & (10 * size >= CONSTANT_TENTHS * F.col("m"))
    return places.select("grp", "constants", F.when(~general, -best["before"]).alias("split"), general.alias("general"))


def _level(lines: DataFrame, level: int) -> DataFrame:
    """lines (grp, full, w: hashes of tokens) with template (null: none yet) and next, their group of the next level (null: they leave the tree)."""
    counts = saved(_counts(lines))
    shape = saved(_shapes(counts))
    n, constants, splits = shape.agg(F.count("*"), F.sum(F.size("constants")), F.count("split")).first()
    # pairs of several lines, at the places where their groups are split
    at = small_side(shape.filter("split IS NOT NULL").select("grp", F.col("split").alias("at")), splits, 20)
    shared = counts.filter("kind = 1").join(at, ["grp", "at"]).select("grp", F.col("token").alias("pair"), F.lit(True).alias("shared"))
    shared = saved(shared)
    pair = F.when(F.col("split").isNotNull(), F.xxhash64(F.col("w")[F.col("split")], F.col("w")[F.col("split") + 1]))
    joined = lines.join(small_side(shape, 60 * n + 24 * (constants or 0), 1), "grp", "left").withColumn("pair", pair)
    joined = joined.join(small_side(shared, shared.count(), 24), ["grp", "pair"], "left")
    rest = F.xxhash64("grp", F.lit("rest"), F.lit(level))
    following = F.when(F.col("general"), rest).when(F.col("shared"), F.xxhash64("grp", "split", "pair")).when(F.col("split").isNotNull(), rest)
    belongs = F.col("general") & F.forall("constants", lambda x: F.col("w")[x["at"]] == x["word"])
    return joined.select("full", "w", F.when(belongs, F.xxhash64("grp", F.lit("template"))).alias("template"), following.alias("next"))


def templates(distinct: DataFrame) -> DataFrame:
    """full and template (a hash) of distinct masked lines (leaf, full, line)."""
    tokens = F.slice(F.split("line", " "), DEPTH + 1, 1 << 30)
    at = distinct.select(F.col("leaf").alias("grp"), "full", F.transform(tokens, lambda w: F.xxhash64(w)).alias("w"))
    found = at.filter(F.size("w") == 0).select("full", F.col("full").alias("template"))
    at = at.filter(F.size("w") > 0)
    for level in range(LEVELS):
        done = saved(_level(at, level))
        last = F.lit(level == LEVELS - 1) | F.col("next").isNull() | F.col("template").isNotNull()
        found = found.unionByName(done.filter(last).select("full", F.coalesce("template", "full").alias("template")))
        at = done.filter(~last).select(F.col("next").alias("grp"), "full", "w")
        if at.isEmpty():
            break
    return found


def recurring(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, copy and i (an array of line numbers) of the lines to drop."""
    all_lines = lines(docs, text)
    seen = saved(all_lines.select("doc_id", "copy", "i", "leaf", "full"))
    leaves = saved(seen.select("leaf", "copy").distinct().groupBy("leaf").agg(F.count("*").alias("c")).filter(F.col("c") >= LEAST_DOCS).select("leaf"))
    shared = small_side(leaves, leaves.count(), 16)
    distinct = all_lines.join(shared, "leaf").groupBy("leaf", "full").agg(F.min(_masked(F.col("line"))).alias("line"))
    known = saved(templates(saved(distinct)))
    tagged = seen.join(small_side(known, known.count(), 24), "full").select("doc_id", "copy", "i", "template")
    often = tagged.groupBy("template", "copy").agg(F.min(F.struct("doc_id", "copy")).alias("first")).groupBy("template").agg(F.count("*").alias("c"), F.min("first").alias("first"))
    often = saved(often.filter(F.col("c") >= LEAST_DOCS).select("template", F.col("first.copy").alias("keeps")))
    gone = tagged.join(small_side(often, often.count(), 24), "template").filter(F.col("copy") != F.col("keeps"))
    return gone.groupBy("doc_id", "copy").agg(F.collect_set("i").alias("i"))  # repeated rows fold before the shuffle


def dedup(docs: DataFrame, text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with recurring lines dropped from text; n_lines (before) and n_dropped are added, or replace columns of these names."""
    # columns of the join that no column of docs is named like
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    gone = recurring(docs, text).select(F.col("doc_id").alias(f"{mark}doc"), F.col("copy").alias(f"{mark}copy"), F.col("i").alias(f"{mark}gone"))
    whole = F.coalesce(F.col(text), F.lit(""))
    # the texts are dealt by document in every case, so that one plan holds at any size
    joined = docs.withColumn(f"{mark}own", F.xxhash64(whole)).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(f"{mark}doc")) & (F.col(f"{mark}own") == F.col(f"{mark}copy")), "left")
    parts = F.split(whole, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(f"{mark}gone"))
    kept = F.array_join(F.transform(stay, lambda k: F.col(f"{mark}parts")[k]), "\n")
    dropped = F.when(F.col(f"{mark}gone").isNotNull(), F.size(f"{mark}gone")).otherwise(0)
    new = {text: F.when(F.col(f"{mark}gone").isNotNull(), kept).otherwise(F.col(text)), n_lines: F.size(parts).cast("long"), n_dropped: dropped.cast("long")}
    rest = [F.col(c) for c in docs.columns if c not in new]
    return joined.withColumn(f"{mark}parts", parts).select(*rest, *[c.alias(k) for k, c in new.items()])


def summary(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, n_chars and the hash of the text that stays."""
    text = F.coalesce("text", F.lit(""))
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def _level_sql(k: int) -> str:
    """Level k of the tree, from l{k} (grp, leaf, line, w) to r{k} with template and next."""
    return rf"""
n{k} AS MATERIALIZED (SELECT grp, count(*) AS n, max(len(w)) AS m FROM l{k} GROUP BY grp HAVING count(*) > 1),
c{k} AS MATERIALIZED (SELECT q.grp, pos, w[pos] AS word FROM (SELECT grp, w, unnest(range(1, len(w) + 1)) AS pos FROM l{k}) q JOIN n{k} n ON q.grp = n.grp GROUP BY 1, 2, 3, n HAVING 2 * count(*) > n),
g{k} AS MATERIALIZED (SELECT c.grp FROM c{k} c JOIN n{k} n ON c.grp = n.grp GROUP BY c.grp HAVING count(*) >= {CONSTANT} AND 10 * count(*) >= {CONSTANT_TENTHS} * max(m)),
p{k} AS MATERIALIZED (SELECT grp, pos, w[pos] AS a, w[pos + 1] AS b, count(*) AS c FROM (SELECT grp, w, unnest(range(1, len(w))) AS pos FROM l{k}) q GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),
s{k} AS MATERIALIZED (
  SELECT grp, pos FROM (SELECT o.grp, pos, row_number() OVER (PARTITION BY o.grp ORDER BY coalesce(list_contains(fixed, pos) OR list_contains(fixed, pos + 1), false), weight DESC, pos) AS rank
    FROM (SELECT grp, pos, sum(c * c) AS weight, max(c) AS top FROM p{k} GROUP BY grp, pos) o JOIN n{k} n ON o.grp = n.grp
    LEFT JOIN (SELECT grp, list(pos) AS fixed FROM c{k} GROUP BY grp) f ON o.grp = f.grp WHERE 2 * top <= n) q WHERE rank = 1),
b{k} AS MATERIALIZED (SELECT l.grp, l.leaf, l.line FROM l{k} l JOIN g{k} g ON l.grp = g.grp JOIN c{k} c ON l.grp = c.grp GROUP BY l.grp, l.leaf, l.line HAVING bool_and(l.w[c.pos] = c.word)),
r{k} AS MATERIALIZED (
  SELECT l.leaf, l.line, l.w, CASE WHEN b.line IS NOT NULL THEN 'template ' || l.grp END AS template,
         CASE WHEN g.grp IS NOT NULL THEN l.grp || ' rest' WHEN p.grp IS NOT NULL THEN l.grp || ' ' || p.pos || '=' || p.a || ' ' || p.b WHEN s.grp IS NOT NULL THEN l.grp || ' rest' END AS next
  FROM l{k} l LEFT JOIN g{k} g ON l.grp = g.grp LEFT JOIN s{k} s ON l.grp = s.grp LEFT JOIN p{k} p ON l.grp = p.grp AND p.pos = s.pos AND l.w[s.pos] = p.a AND l.w[s.pos + 1] = p.b
  LEFT JOIN b{k} b ON l.grp = b.grp AND l.line = b.line),
l{k + 1} AS MATERIALIZED (SELECT next AS grp, leaf, line, w FROM r{k} WHERE template IS NULL AND next IS NOT NULL)"""


_LEVELS_SQL = ",".join(_level_sql(k) for k in range(LEVELS))
_FOUND_SQL = " UNION ALL ".join(f"SELECT leaf, line, coalesce(template, 'line ' || line) AS template FROM r{k}{' WHERE template IS NOT NULL OR next IS NULL' if k < LEVELS - 1 else ''}" for k in range(LEVELS))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, text, i, trim(ls[i], ' ') AS line FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) q),
l AS (
  SELECT doc_id, text, i, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line, len(string_split(line, ' ')) AS n
  FROM e WHERE line <> '' AND len(string_split(line, ' ')) >= {LEAST_TOKENS}),
m AS (SELECT *, n || '/' || array_to_string(string_split(line, ' ')[1:{DEPTH}], ' ') AS leaf FROM l),
hot AS (SELECT leaf FROM m GROUP BY leaf HAVING count(DISTINCT text) >= {LEAST_DOCS}),
u AS (SELECT DISTINCT leaf, line FROM m WHERE leaf IN (SELECT leaf FROM hot)),
v AS (SELECT leaf, line, string_split(line, ' ')[{DEPTH + 1}:] AS w FROM u),
l0 AS (SELECT leaf AS grp, leaf, line, w FROM v WHERE len(w) > 0),{_LEVELS_SQL},
k AS ({_FOUND_SQL} UNION ALL SELECT leaf, line, 'line ' || line AS template FROM v WHERE len(w) = 0),
g AS (SELECT m.doc_id, m.text, m.i, k.template FROM m JOIN k ON m.leaf = k.leaf AND m.line = k.line),
f AS (
  SELECT template, arg_min(text, doc_id) AS keeps FROM g GROUP BY template HAVING count(DISTINCT text) >= {LEAST_DOCS}),
x AS (SELECT DISTINCT g.doc_id, g.i FROM g JOIN f ON g.template = f.template AND g.text <> f.keeps),
o AS (
  SELECT e.doc_id, count(x.i) AS n_dropped,
         coalesce(string_agg(q.raw, chr(10) ORDER BY e.i) FILTER (WHERE x.i IS NULL), '') AS text
  FROM e JOIN (SELECT doc_id, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS i FROM d) q ON e.doc_id = q.doc_id AND e.i = q.i
  LEFT JOIN x ON e.doc_id = x.doc_id AND e.i = x.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, CAST(o.n_dropped AS BIGINT) AS n_dropped,
       CAST(length(o.text) AS BIGINT) AS n_chars, sha256(o.text) AS text_sha256
FROM d JOIN o ON d.doc_id = o.doc_id
"""
