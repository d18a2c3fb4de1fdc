"""Quality rules: a table of thresholds compiled into one projection.

Every rule bounds a ratio of counts over the whole text. The counts are built-in expressions (arrays, hashes and
higher-order functions), so the rules run inside the scan, without a shuffle and without user functions.

Null text counts as no words. Rows are judged one by one: repeated rows, ties and further columns change nothing. An
empty text fails the base rule and is not kept. Three-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import words

SYMBOLS = "#*$%&|<>"
#: Frequent words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "le la les de des du et un une en est que qui dans pour pas au sur ce il elle ne se plus par avec son "
    "der die das und den von zu mit sich ist nicht ein eine auf dem für im auch es an werden aus er hat dass "
    "el los las y una por con no su para como más pero sus al lo este ha si"
).split()


@dataclass(frozen=True)
class Rule:
    """Bounds for numerator / denominator; a denominator of 0 fails a rule that has a lower bound."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_a_word", "n_symbols", "n_words", None, 0.1),
    Rule("shouts_a_word", "n_shouts", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.06, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_a_line", "n_words", "n_lines", 3.0, None),
)


def _passes(rule: Rule) -> Column:
    """The rule as products of counts, without a division."""
    top, below = F.col(rule.numerator).cast("double"), F.col(rule.denominator).cast("double")
    bounds = [top >= rule.least * below] if rule.least is not None else []
    bounds += [top <= rule.most * below] if rule.most is not None else []
    return reduce(lambda a, b: a & b, bounds)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_shouts, n_stop_words, n_lines, n_dup_lines and n_repeat_words.

    n_lines and n_dup_lines count lines that have a word; n_repeat_words counts the words inside three-word windows that
    occur twice or more in the text, the first occurrence included.
    """
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    w, h, s, p = (F.col(f"{mark}{k}") for k in "whsp")
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({f"{mark}w": words(F.col(text)), f"{mark}l": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns({"n_words": F.size(f"{mark}w").cast("long"), f"{mark}j": F.array_join(f"{mark}w", ""), f"{mark}h": F.when(F.size(f"{mark}w") >= 3, F.transform(F.sequence(F.lit(0), F.size(f"{mark}w") - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))})
    df = df.withColumns(
        {
            "word_chars": F.length(f"{mark}j").cast("long"),
            "n_symbols": F.regexp_count(f"{mark}j", F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_shouts": F.regexp_count(whole, F.lit("!!")).cast("long"),
            "n_stop_words": F.size(F.filter(f"{mark}w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
            "n_lines": F.size(f"{mark}l").cast("long"),
            "n_dup_lines": (F.size(f"{mark}l") - F.size(F.array_distinct(f"{mark}l"))).cast("long"),
            # windows by hash and place, only where some hash occurs twice
            f"{mark}s": F.when(F.size(F.array_distinct(f"{mark}h")) < F.size(f"{mark}h"), F.sort_array(F.transform(f"{mark}h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
        }
    )
    last = F.size(f"{mark}s") - 1
    twice = lambda k: (F.when(k > 0, s[k].h == s[k - 1].h).otherwise(False)) | (F.when(k < last, s[k].h == s[k + 1].h).otherwise(False))
    df = df.withColumn(f"{mark}p", F.when(s.isNotNull(), F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twice), lambda k: s[k].i))))
    # the k-th window adds the words that the one before doesn't reach
    covered = F.aggregate(F.sequence(F.lit(0), F.size(f"{mark}p") - 1), F.lit(0), lambda n, k: n + F.when(k == 0, 3).otherwise(F.least(F.lit(3), p[k] - p[k - 1])))
    df = df.withColumn("n_repeat_words", F.when(p.isNotNull(), covered).otherwise(0).cast("long"))
    return df.drop(f"{mark}w", f"{mark}l", f"{mark}j", f"{mark}h", f"{mark}s", f"{mark}p")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, failed_rules (names) and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    df = counts(docs, text).withColumns({"base_failed": base, "failed_rules": failed})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def _rules_sql() -> str:
    parts = []
    for r in RULES:
        parts += [f"CAST({r.numerator} AS DOUBLE) >= CAST({r.least} AS DOUBLE) * CAST({r.denominator} AS DOUBLE)"] * (r.least is not None)
        parts += [f"CAST({r.numerator} AS DOUBLE) <= CAST({r.most} AS DOUBLE) * CAST({r.denominator} AS DOUBLE)"] * (r.most is not None)
    return " AND ".join(parts)


ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS whole, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) >= 3) q),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) q WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) o GROUP BY doc_id),
c AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(array_to_string(ws, ''), '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(regexp_extract_all(whole, '!!')) AS BIGINT) AS n_shouts,
         CAST(len(list_filter(ws, lambda w: list_contains([{", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}], lower(w)))) AS BIGINT) AS n_stop_words,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rules_sql()} AS kept
FROM b
"""
