"""The queries of the training-data operators, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.llm import chat_format, conversation_repair, importance, jaccard_join, license_scan, line_dedup, packing, progressive_jpeg, quality_classifier, quality_rules, secret_scan, sentencepiece_bpe, warc
from geolode.llm.common import saved, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.examples(turns.unionByName(more)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(license_scan.paths(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "path", "own_license", "score", "license", "license_from")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(table(spark, sf_dir, "documents"))
    return secret_scan.summary(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = progressive_jpeg.media_columns(table(spark, sf_dir, "documents"))
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("jpeg").cast("long").alias("media_bytes"),
        F.sha2("jpeg", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        F.octet_length("rgb").cast("long").alias("rgb_bytes"),
        F.sha2("rgb", 256).alias("rgb_sha256"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = importance.scored(docs, importance.learned(docs, table(spark, sf_dir, "benchmark")), keep=["doc_id"])
    return importance.ranked(saved(scores)).select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_license_scan, op3_quality_rules, op4_quality_classifier, op5_secret_scan, op6_progressive_jpeg, op7_jaccard_join, op8_best_fit_packing, op9_sentencepiece, op10_line_dedup, op11_importance_resampling, op12_warc, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat_format.ORACLE_SQL, "op2_license_scan": license_scan.ORACLE_SQL, "op3_quality_rules": quality_rules.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL, "op11_importance_resampling": importance.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL, "op13_conversation_repair": conversation_repair.ORACLE_SQL}
