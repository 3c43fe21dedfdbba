"""A training corpus from the documents table, in five stages; each works on all that its predecessor kept.

toxicity: documents that the model of op7 rejects go. line_dedup: lines of many documents stay in one. near_dedup: one
document of each class stays. substring_dedup: repeated passages stay where they are first. packing: the sequences.
A stage takes (spark, docs, sf_dir) and returns the next one's docs; the last returns a row for each packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import toxicity as tox
from quillon.llm.common import table, written
from quillon.llm.line_dedup import line_dedup as drop_lines
from quillon.llm.near_dedup import drop_near_duplicates
from quillon.llm.packing import pack_along_curve, with_crc32
from quillon.llm.queries_models import toxicity_model
from quillon.llm.substring_dedup import substring_dedup as cut_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic. Null texts count as empty and are judged as such; null ids and
    repeated rows are judged like others; an empty table stays empty."""
    return tox.score(docs, toxicity_model(spark, sf_dir, docs)).filter(F.col("toxic") == 0).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points that three documents hold stay in the last of them alone. Null texts become
    empty; rows with a null id stay whole; rows that repeat an id are one document; an empty table stays empty."""
    return _documents(drop_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays. Null texts are empty ones, all of which are one class;
    rows with a null id stay; rows that repeat an id stay or go together; an empty table stays empty."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they occur first. Null texts become empty; rows with a null id stay
    whole; rows that repeat id and text are cut alike; an empty table stays empty."""
    return _documents(cut_passages(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. Null texts are the end id alone; null ids stay null; repeated
    rows are packed as often as they occur; an empty table gives no rows."""
    pieces = with_crc32(pack_along_curve(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Models and packing along the curve can't be put in SQL: tests/llm/test_pipeline.py compares each stage with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
