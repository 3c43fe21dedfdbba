"""Queries of the trained scorers over the whole documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language_id, toxicity
from quillon.llm.class_lm import class_lm_scores
from quillon.llm.common import table


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicityModel:
    """Fitted on the labelled rows outside the held-out fold."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold(4) != 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), F.coalesce(fold(7) != 2, F.lit(True)))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, F.coalesce(fold(5) != 0, F.lit(False)))
    held_out = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


QUERIES = {"op6_class_lm": op6_class_lm, "op7_toxicity": op7_toxicity, "op12_language_id": op12_language_id}
ORACLES: dict[str, str] = {}
