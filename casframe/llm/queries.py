"""The corpus operators as queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.llm import html_extract, langid, line_dedup, media, minhash, mixing, packing, quality, suffix_dedup, toxicity
from casframe.llm.common import id_bucket, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by document; one with a null id is in neither fold: held_out is null and nothing is learned from it."""
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(id_bucket(F.col("doc_id"), 5) != 0), langid.vocabulary_path())
    return langid.apply(documents, model).select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn place: document, source, pass over the source, position in tokens within the pass."""
    documents = table(spark, sf_dir, "documents")
    return mixing.draw(spark, documents, report=True).select(F.col("key").alias("doc_id"), F.col("src").alias("source"), F.col("pass").cast("long").alias("pass"), "position", "tokens")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without cross-site boilerplate lines."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("whole", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)))
    out = line_dedup.dedup(spark, documents)
    return out.select("doc_id", (F.col("whole") - F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0))).cast("long").alias("n_removed"), "text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.apply(table(spark, sf_dir, "pages"), html_extract.fit())


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(spark, table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity by document; one with a null id is in neither fold: held_out is null and nothing is learned from it."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(id_bucket(F.col("doc_id"), 3) != 1))
    return toxicity.apply(documents, model).select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "n_segments")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(spark, table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.apply(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_language_id, op3_source_mixing, op4_line_dedup, op5_packing, op6_html_extraction, op7_minhash_near_dedup, op8_toxicity, op9_media_columns, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.ORACLE_SQL}
