"""The query of near-duplicate classes over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.near_dedup import near_duplicate_classes


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLES: dict[str, str] = {}
