"""Helpers that several corpus operators share: tables, shared folders, bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shared import kept

#: Bytes of text that a Python worker holds at a time, besides one text that is longer.
SLICE_BYTES = 4 << 20


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below ``sf_dir``, read by Spark alone (any store).

    Where the session has Spark's default of 10,000 rows for a batch that goes to Python, it gets 3,000: rows here are
    documents of some KB, and several batches of them stand beside an executor's heap at a time.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "3000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables in the shared folder (``spark.checkpoint.dir``), which quillon.shared.discard deletes.
written = kept


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as the plan's authors set them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that one task of a shuffle shall get, about.
TASK_BYTES = 64 << 20


def tasks_for(spark: SparkSession, size: int) -> int:
    """Tasks for so many bytes: the session's, or more if theirs would be too large."""
    return int(max(parallelism(spark), -(-(size or 0) // TASK_BYTES)))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


#: Parts that the rows of one key are dealt into.
SALTS = 8


def salted_join(rows: DataFrame, totals: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows joined with totals (one row for each key): a key that a third of all rows have goes to SALTS tasks by the
    hash of another column, and both sides are plain shuffles, so that Spark can split what is still large."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(5), by), F.lit(SALTS)).cast("int"))
    return dealt.join(totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "__salt"]).drop("__salt")


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks and wait beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Cuts record batches so that the strings of ``column`` in each hold at most ``limit`` bytes, or are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, size
    give_back()


def words(texts: pa.Array, lower: bool = True):
    """(dictionary, codes, offsets): the texts' words between ASCII white space, with A-Z in lower case.

    Null and empty texts have no words. The dictionary is a string array, ``codes[offsets[i]:offsets[i+1]]`` are
    the words of text i.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lengths = np.asarray(pc.list_value_length(parts), dtype=np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    if (void := np.asarray(pc.equal(texts, ""), dtype=bool)).any():  # an empty text splits to one empty word
        keep = np.ones(len(codes), bool)
        keep[(np.cumsum(lengths) - lengths)[void & (lengths > 0)]] = False
        codes, lengths = codes[keep], np.where(void, 0, lengths)
    return coded.dictionary, codes, np.concatenate([[0], np.cumsum(lengths)])


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with each byte replaced by ``table[byte]``, which must keep bytes of 128 and more; null is empty."""
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(table[data]))


def word_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same on every machine."""
    return np.fromiter(map(xxhash.xxh64_intdigest, values.to_pylist()), np.uint64, len(values))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor, shift): well spread, the same on every machine."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
