r"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above.

A text is compared as a whole (a licence file), by paragraphs (a header; comment marks are no terms), by lines and by sentences. Terms
are runs of a-z and 0-9 in lower case, weighted by their number in the piece times ``ln(1 + n / (1 + df))``, where df of the n texts have the
term. The best template at ``COSINE`` or more over all pieces is the file's own license. A file without one takes the license of the
nearest directory at or above its own that holds a licence file with a license of its own.

Two exact bounds keep most pieces out. A piece that reaches ``COSINE`` with a template has at least one of the template's rarer terms, the
anchors: the template's most frequent terms together are too light. And the weight of a piece is at least that of the terms that templates have,
with the least possible weight for each further term. Anchors and weights come from the templates, so their number is bounded by these, whatever the
corpus; the frequencies of all terms are counted with pre-aggregation and joined by shuffles. Pieces and texts are scored once, however
many files have them. Directories are resolved once each, by joins of their ancestors' paths with the directories of licence
files, and files then join their directory; a directory with very many files is only a skewed key, which adaptive
execution splits.

Null texts count as empty and have no license of their own. Ties go to the smaller template name. Of several licence files in a
directory the one with the smallest license name counts. Repeated rows each give a row; rows with a null path have no directory;
an empty table gives no rows; further columns pass through, unless a result column has their name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import saved, small_side
from geolode.llm.licence_texts import TEMPLATES

COSINE = 0.6
LICENCE_FILES = "^(licen[sc]e|copying|notice)([.].*)?$"
#: Below COSINE by more than sums of doubles can differ.
SLACK = COSINE * (1 - 1e-6)


def _terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


COUNTS = tuple((k, name, Counter(_terms(text))) for k, (name, text) in enumerate(TEMPLATES))
VOCABULARY = sorted({t for *_, counts in COUNTS for t in counts})


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def pieces(text: Column) -> Column:
    """The text, its paragraphs, lines and sentences, each once."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(F.array(whole), F.split(whole, "\n[ \t\r]*\n"), F.split(whole, "\n"), F.split(whole, r"\. |\n")))


def _weights(n: int, df: dict[str, int]) -> dict[str, float]:
    return {t: math.log(1 + n / (1 + df.get(t, 0))) for t in VOCABULARY}


def anchors(idf: dict[str, float]) -> list[str]:
    """Terms of which a piece needs one: of each template all but its most frequent terms, as far as these can't reach COSINE by themselves."""
    out = set()
    for *_, counts in COUNTS:
        by_idf = sorted(counts, key=lambda t: (idf[t], t))
        squares = [(counts[t] * idf[t]) ** 2 for t in by_idf]
        light, rest = SLACK**2 * sum(squares), 0.0
        for k, s in enumerate(squares):
            rest += s
            if rest >= light:
                out |= set(by_idf[k:])
                break
    return sorted(out)


def own_licenses(texts: DataFrame) -> DataFrame:
    """content (MD5 of the text), license and score of every text (column text) that has a license of its own."""
    spark = texts.sparkSession
    content = F.md5(F.coalesce("text", F.lit("")))
    df = saved(texts.select(F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n = texts.count() or 1
    known = spark.createDataFrame([(t,) for t in VOCABULARY], "term string")
    idf = _weights(n, {r["term"]: r["df"] for r in df.join(F.broadcast(known), "term").collect()})  # a row for each term of the templates at most
    norms = {k: math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items())) for k, _, counts in COUNTS}
    weighed = [(k, name, t, c * idf[t] * idf[t] / norms[k]) for k, name, counts in COUNTS for t, c in counts.items()]
    weighed = F.broadcast(spark.createDataFrame(weighed, "template int, license string, term string, w double"))  # a row for each template and term
    seen = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))

    # pieces with an anchor, each once
    has = F.lower("piece").rlike(rf"(?<![a-z0-9])({'|'.join(anchors(idf))})(?![a-z0-9])")
    some = texts.select(content.alias("content"), F.col("text")).filter(F.lower("text").rlike(rf"(?<![a-z0-9])({'|'.join(anchors(idf))})(?![a-z0-9])"))
    held = saved(some.select("content", F.explode(pieces(F.col("text"))).alias("piece")).filter(has).distinct().withColumn("key", F.md5("piece")))
    found = held.groupBy("key").agg(F.first("piece").alias("piece")).withColumn("terms", terms(F.col("piece")))
    vocabulary = F.array(*[F.lit(t) for t in VOCABULARY])
    further = F.size(F.array_except("terms", vocabulary))
    found = saved(found.select("key", "terms", further.alias("further")))
    counted = found.select("key", "further", F.explode("terms").alias("term")).join(seen, "term").groupBy("key", "further", "term", "idf").agg(F.count("*").alias("tf"))
    inside = counted.groupBy("key").agg((F.sum(F.pow(F.col("tf") * F.col("idf"), 2)) + F.first("further") * math.log(1 + n / (1 + n)) ** 2).alias("least"))
    dots = counted.join(weighed, "term").groupBy("key", "template", "license").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"))
    dots = saved(dots.join(inside, "key").filter(F.col("dot") >= SLACK * F.sqrt("least")).select("key", "license", "dot"))
    # the whole weight of what is left
    left = dots.select("key").distinct()
    all_terms = found.join(left, "key").select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * F.log(1 + F.lit(float(n)) / (1 + F.col("df")))
    norm = all_terms.join(df, "term").groupBy("key").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    scores = dots.join(norm, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= COSINE)
    best = scores.groupBy("key", "license").agg(F.max("score").alias("score"))
    best = saved(best.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best")))
    own = held.select("content", "key").join(small_side(best, best.count(), 80), "key").groupBy("content").agg(F.min("best").alias("best"))
    return own.select("content", "best.license", (-F.col("best.less")).alias("score"))


def directory(path: Column) -> Column:
    """Path of the directory, without a slash at its end; empty for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The directory and those above it, with the top as ''."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.when(folder == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


RESULT = ("own_license", "score", "license", "license_from")


def scan(files: DataFrame) -> DataFrame:
    """files (path, text and others) with own_license, score, license and license_from (the directory; null if its own or none)."""
    files = files.select(*[c for c in files.columns if c not in RESULT])
    # names of the joins' own columns, which no column of files has
    mark = "__"
    while any(c.startswith(mark) for c in files.columns):
        mark += "_"
    content, folder, above, given = (mark + k for k in ("content", "folder", "above", "given"))
    own = saved(own_licenses(files.select("text"))).withColumnsRenamed({"content": content, "license": "own_license"})
    keyed = files.withColumns({content: F.md5(F.coalesce("text", F.lit(""))), folder: directory(F.col("path"))})
    own = small_side(own, own.count(), 100)
    named = keyed.filter(F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike(LICENCE_FILES)).select(content, folder)
    gives = saved(named.join(own, content).groupBy(F.col(folder).alias(above)).agg(F.min("own_license").alias(given)))
    folders = keyed.select(folder).filter(F.col(folder).isNotNull()).distinct()
    nearest = folders.select(folder, F.explode(ancestors(F.col(folder))).alias(above)).join(gives, above)
    nearest = nearest.groupBy(folder).agg(F.max(F.struct(F.length(above).alias("depth"), F.col(above), F.col(given))).alias("n"))
    nearest = saved(nearest.select(folder, F.col("n")[above].alias(above), F.col("n")[given].alias(given)))
    longest = nearest.agg(F.sum(F.octet_length(folder) + F.octet_length(above) + 60)).first()[0]
    joined = keyed.join(own, content, "left").join(small_side(nearest, longest or 0, 1), folder, "left")
    none = F.col("own_license").isNull()
    return joined.select(*files.columns, "own_license", "score", F.coalesce("own_license", given).alias("license"), F.when(none, F.col(above)).alias("license_from"))


def paths(docs: DataFrame) -> DataFrame:
    """documents as files: source / thousands / hundreds / name; of every thirty, one each stands for a licence file of these three directories."""
    k, h = F.floor(F.col("doc_id") / 1000).cast("string"), F.pmod(F.floor(F.col("doc_id") / 100), F.lit(10)).cast("string")
    name = F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))
    turn = F.pmod("doc_id", F.lit(30))
    path = F.when(turn == 0, F.concat_ws("/", "source", name)).when(turn == 10, F.concat_ws("/", "source", k, name)).when(turn == 20, F.concat_ws("/", "source", k, h, name))
    return docs.select("doc_id", "text", F.coalesce(path, F.concat_ws("/", F.col("source"), k, h, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path"))


_VALUES = ", ".join(f"({k}, '{name}', '{t}', {c})" for k, name, counts in COUNTS for t, c in counts.items())
ORACLE_SQL = rf"""
WITH f AS (
  SELECT doc_id, coalesce(text, '') AS text, source || '/' ||
         CASE doc_id % 30 WHEN 0 THEN '' WHEN 10 THEN (doc_id // 1000) || '/' ELSE (doc_id // 1000) || '/' || (doc_id // 100 % 10) || '/' END ||
         CASE WHEN doc_id % 30 IN (0, 10, 20) THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS path FROM documents),
v AS (SELECT * FROM (VALUES {_VALUES}) x(template, license, term, tf)),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM f) q GROUP BY term),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM f),
idf AS (
  SELECT t.term, ln(1 + n.n / (1 + coalesce(df, 0))) AS idf
  FROM (SELECT term FROM df UNION SELECT term FROM v) t CROSS JOIN n LEFT JOIN df ON t.term = df.term),
tw AS (SELECT template, license, v.term, tf * idf AS w FROM v JOIN idf ON v.term = idf.term),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
s AS (
  SELECT DISTINCT doc_id, unnest(list_concat([text], regexp_split_to_array(text, '\n[ \t\r]*\n'), string_split(text, chr(10)), regexp_split_to_array(text, '\. |\n'))) AS piece FROM f),
u AS (SELECT piece, row_number() OVER () AS id FROM (SELECT DISTINCT piece FROM s) q),
c AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(piece), '[a-z0-9]+')) AS term FROM u) q GROUP BY 1, 2),
l AS (SELECT id, c.term, tf * idf AS w FROM c JOIN idf ON c.term = idf.term),
ln_ AS (SELECT id, sqrt(sum(w * w)) AS norm FROM l GROUP BY id),
d AS (SELECT id, tw.template, tw.license, sum(l.w * tw.w) AS dot FROM l JOIN tw ON l.term = tw.term GROUP BY 1, 2, 3),
sc AS (SELECT d.id, d.license, round(dot / (ln_.norm * tn.norm), 6) AS score FROM d JOIN ln_ ON d.id = ln_.id JOIN tn ON d.template = tn.template),
hit AS (SELECT u.piece, sc.license, sc.score FROM sc JOIN u ON sc.id = u.id WHERE score >= {COSINE}),
own AS (SELECT doc_id, license AS own_license, score FROM (
  SELECT s.doc_id, hit.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY score DESC, license) AS k FROM s JOIN hit ON s.piece = hit.piece) q WHERE k = 1),
fd AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/[^/]*$', '') AS folder FROM f),
given AS (SELECT folder AS above, min(own_license) AS given FROM fd JOIN own ON fd.doc_id = own.doc_id WHERE path LIKE '%/LICENSE.%' GROUP BY 1),
near AS (
  SELECT doc_id, above, given, row_number() OVER (PARTITION BY doc_id ORDER BY length(above) DESC) AS k
  FROM fd JOIN given ON folder = above OR starts_with(folder, above || '/'))
SELECT fd.doc_id, fd.path, own.own_license, own.score, coalesce(own.own_license, near.given) AS license,
       CASE WHEN own.own_license IS NULL THEN near.above END AS license_from
FROM fd LEFT JOIN own ON fd.doc_id = own.doc_id LEFT JOIN near ON fd.doc_id = near.doc_id AND near.k = 1
"""
