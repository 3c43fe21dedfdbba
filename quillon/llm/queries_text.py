"""Queries of the TIFF column and of substring dedup over the whole documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.llm.common import table
from quillon.llm.packing import pack_along_curve, with_crc32
from quillon.llm.substring_dedup import substring_dedup
from quillon.llm.tiff import page_features, store_texts, tiff_pages


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack_along_curve(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return with_crc32(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pages = page_features(tiff_pages(stored))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "page",
        "compression",
        "error",
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("chars_removed"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


QUERIES = {"op2_packing": op2_packing, "op3_tiff": op3_tiff, "op4_bpe": op4_bpe, "op10_substring_dedup": op10_substring_dedup}
ORACLES: dict[str, str] = {}
