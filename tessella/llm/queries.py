"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the package is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .id_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    return derivatives(responses(_table(spark, sf_dir, "pages")), digests=True)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    out = license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bigrams", F.array_join("licenses", ",").alias("licenses"), "n_matches", F.round("best", 6).alias("best"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import passage_dedup

    out = passage_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"), n=3, similarity=(9, 10)).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train, training_labels

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, training_labels(_table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_table import word_table_codec

    return word_table_codec(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_binary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_split import binary_split

    return binary_split(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_token_files, op4_warc, op5_media, op6_license_scan, op7_line_dedup, op8_ngram_join, op9_toxicity, op10_word_table, op11_hard_negatives, op12_binary_split, op13_vector_codes, pipeline)}


def oracle_sql() -> dict[str, str]:
    from .hard_negatives import oracle as negatives
    from .license_scan import oracle
    from .quality_rules import ORACLE_COUNTS
    from .vector_codes import oracle as codes

    return {"op2_quality_rules": ORACLE_COUNTS, "op6_license_scan": oracle(), "op11_hard_negatives": negatives(), "op13_vector_codes": codes()}
