"""Corpus pipeline over ``documents``: quality classifier, line dedup, near duplicates, secrets, packing.

Each stage works on all rows that the one before kept and acts on its decisions: documents that the classifier rejects go,
recurring lines go (and documents that lose all their words with them), one document of each group of near duplicates stays,
secrets are replaced by a mark, and what is left is packed into sequences. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.llm import jaccard_join, line_dedup, packing, quality_classifier, secret_scan
from geolode.llm.common import table, without_clash, written
from geolode.llm.registry import tokenizer_path

#: Near duplicates share this much of their sets of word n-grams (``op7_jaccard_join`` has values of its own).
WIDTH, NUMERATOR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and empty texts are scored like all others (by statistics that are all 0). Very long texts are scored whole. Equal texts have equal scores, so repeated rows and
    ties stay or go together; rows without a doc_id are scored, but have no label. Without documents nothing comes; without labels nothing is rejected by learning
    from them, as the operator says. All columns stay.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.fit(quality_classifier.with_statistics(quality_classifier.labelled(docs, labels)), labels)
    return quality_classifier.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, and n_chars of what is left; those that lose all their words go.

    Null texts stay null and empty ones empty. Of lines that recur the text of the smallest doc_id (null before all) keeps its own, and exact copies of that text, so repeated
    rows are treated alike. Very long texts lose lines like all others. An empty table stays empty. All columns stay, whatever their names.
    """
    mark = without_clash(docs)
    n_lines, n_dropped = f"{mark}lines", f"{mark}dropped"
    left = line_dedup.dedup(docs, n_lines=n_lines, n_dropped=n_dropped).filter((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


#: Keys of rows without a doc_id begin here, behind all others.
NO_ID = 1 << 62


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row, that of its smallest doc_id.

    Rows without a doc_id come after all others and are told apart by their place in the table, which as a written one is the same whenever it is read; so they are
    near duplicates like others. Texts without words, null ones too, are linked with nothing and stay. Of rows that repeat a doc_id and its text one stays. Very long texts
    are compared whole. An empty table stays empty. All columns stay, whatever their names.
    """
    mark = without_clash(docs)
    key, first = f"{mark}key", f"{mark}first"
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id() + NO_ID))
    classes = jaccard_join.classes(keyed.select(F.col(key).alias("doc_id"), "text"), WIDTH, NUMERATOR)
    least = classes.filter("doc_id = component_id").select(F.col("doc_id").alias(first)).distinct()
    return keyed.join(least.hint("merge"), F.col(key) == F.col(first), "left_semi").dropDuplicates([key, "text"]).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of secrets, and n_chars of what is left; no row goes.

    Null and empty texts stay as they are, very long ones are scanned whole, repeated rows change alike, rows without a doc_id like others. An empty table stays empty. All
    columns stay, whatever their names.
    """
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; the columns are those of the packing.

    Null and empty texts are one piece of one token. Very long texts are cut into full pieces. Among pieces of one length the order is arbitrary, and repeated rows and rows
    without a doc_id are packed by themselves. An empty table gives no sequences.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]
#: SQL expresses neither the classifier nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
