"""Importance resampling towards a target's distribution: hashed word n-grams, weights from an array of gains, an exact
draw without replacement by perturbed scores.

The gains of all buckets are one array, which scores a text's features by indexing. Scored rows are sorted into a run
for each partition and written once. Cuts taken from the runs at regular places divide all runs into ranges of like
size; a range's pieces are merged by a tournament tree, which stops where the draw is complete. Ranges beyond it are
not merged at all.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import parallelism, slices, translated, words, written

#: Bytes that are no part of a word become spaces, A-Z become lower case; 0-9, a-z and all of 128 and more stay.
WORD_BYTES = np.full(256, 32, np.uint8)
WORD_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x80:] = np.arange(0x80, 0x100)

#: Rows of a range, which one task merges, about.
RANGE_ROWS = 1 << 18
#: Cuts that are looked at for each range.
LOOKS = 16
#: Words of up to so many bytes have their shift of a checksum in a table.
SHIFTS = 64


def _shift_tables() -> np.ndarray:
    """[n, j, b]: what byte j of a checksum, being b, becomes when n zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((SHIFTS + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(SHIFTS):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> 8)
    return out


_TABLES = _shift_tables()


def feature_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of each word with its successor or -1, offsets of the texts): the bucket is the
    crc32 of the feature's bytes modulo ``buckets``. A pair's crc32 comes from its members' (checksums are linear)."""
    dictionary, codes, offsets = words(translated(texts, WORD_BYTES), lower=False)
    spelt = dictionary.cast(pa.binary()).to_pylist()
    alone = np.fromiter(map(zlib.crc32, spelt), np.uint32, len(spelt))
    first = np.fromiter((zlib.crc32(b" ", int(c)) for c in alone), np.uint32, len(spelt))
    length = np.fromiter(map(len, spelt), np.int64, len(spelt))
    pair = np.full(len(codes), -1, np.int64)
    if len(codes) > 1:
        a, b = codes[:-1], codes[1:]
        crc, n = first[a], np.minimum(length[b], SHIFTS)
        moved = alone[b].copy()
        for j in range(4):
            moved ^= _TABLES[n, j, (crc >> np.uint32(8 * j)) & np.uint32(255)]
        for i in np.flatnonzero(length[b] > SHIFTS).tolist():
            moved[i] = zlib.crc32(spelt[b[i]], int(crc[i]))
        pair[:-1] = moved % buckets
        ends = offsets[1:-1]
        pair[ends[(ends > 0) & (ends < len(codes))] - 1] = -1  # a text's last word has no successor
    return (alone % buckets).astype(np.int64)[codes], pair, offsets


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; each task adds its own up first."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, text_col):
            one, two, _ = feature_buckets(batch[text_col], buckets)
            total += np.bincount(one, minlength=buckets) + np.bincount(two + 1, minlength=buckets + 1)[1:]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of a bucket's smoothed share in the target and in the corpus, floored."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


class Tournament:
    """A tree of losers over sorted runs: the smallest head wins, and the next head of its run plays its way up."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, (math.inf,)) for r in self.runs]
        k = len(self.runs)
        self.losers = [0] * k
        won = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            left, right = won[2 * node], won[2 * node + 1]
            left_wins = self.heads[left] <= self.heads[right]
            won[node], self.losers[node] = (left, right) if left_wins else (right, left)
        self.winner = won[1] if k > 1 else 0

    def take(self, n: int):
        """The n smallest keys in order; the runs hold at least as many."""
        heads, losers, k = self.heads, self.losers, len(self.runs)
        for _ in range(n):
            best = self.winner
            yield heads[best]
            heads[best] = next(self.runs[best], (math.inf,))
            node = (best + k) // 2
            while node:
                other = losers[node]
                if heads[other] < heads[best]:
                    losers[node], best = best, other
                node //= 2
            self.winner = best


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """The order of the draw: higher scores, smaller ids, null ids last; equal rows by run and place."""
    ids = batch["id"].to_pylist()
    return [(-s, i is None, 0 if i is None else i, run, at) for s, i, run, at in zip(batch["score"].to_pylist(), ids, batch["run"].to_pylist(), batch["at"].to_pylist(), strict=True)]


def _in_ranges(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``runs`` with the number of the range that each row falls into: how many cuts are not above it."""
    above = np.array([c[0] for c in cuts], dtype=np.int64)
    shared = runs.sparkSession.sparkContext.broadcast((cuts, above))  # LOOKS-th of the looked-at rows: one for each range

    def find(batches):
        for batch in batches:
            cuts, above = shared.value
            scores = -np.asarray(batch["score"], dtype=np.int64)
            low, high = np.searchsorted(above, scores, side="left"), np.searchsorted(above, scores, side="right")
            part = high.astype(np.int32)
            tied = np.flatnonzero(low < high)
            for i, key in zip(tied.tolist(), _keys(batch.take(pa.array(tied))), strict=True):
                part[i] = bisect_right(cuts, key, lo=int(low[i]), hi=int(high[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    return runs.mapInArrow(find, T.StructType([*runs.schema.fields, T.StructField("part", T.IntegerType())]))


def _ranges(batches):
    """(number of the range, its rows) for each range of a stream that is sorted by range, run and place."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        parts = np.asarray(batch["part"])
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0]["part"][0].as_py() != parts[a]:
                yield held[0]["part"][0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0]["part"][0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def importance_ranks(
    docs: DataFrame, target: DataFrame, percent: int = 25, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, min_words: int = 20, seed: int = 7, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """A row for each row of ``docs``: id_col, n_features, weight, score and rank, 1, 2, 3... for the drawn ones in
    order and null for the others. ``percent`` of the documents of at least ``min_words`` words are drawn, floored.

    Null and empty texts have no features and weight 0. A null id counts as an empty one in the score and comes after
    other ids among ties; repeated rows are drawn one by one. An empty target gives equal gains to equally frequent
    buckets; an empty table gives no rows. Other columns of ``docs`` are left behind.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(texts, "text", buckets), bucket_counts(target.select(F.col(target_text_col).alias("text")), "text", buckets))

    def weigh(batches):
        for batch in slices(batches, "text"):
            one, two, offsets = feature_buckets(batch["text"], buckets)
            total = np.concatenate([[0], np.cumsum(gains[one] + np.where(two >= 0, gains[two], 0))])
            n = np.maximum(2 * np.diff(offsets) - 1, 0)
            weight = (total[offsets[1:]] - total[offsets[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n), pa.array(weight)], names=["id", "n_features", "weight"])

    kind = texts.schema["id"]
    weighed = texts.mapInArrow(weigh, T.StructType([kind, T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000.0 * F.ln(-F.ln((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_features") >= 2 * min_words - 1)
    place = F.monotonically_increasing_id()  # partition, and place in it
    sorted_rows = scored.sortWithinPartitions(F.desc("able"), F.desc("score"), F.asc_nulls_last("id")).withColumn("place", place)
    runs = written(sorted_rows.select("*", F.shiftright("place", 33).alias("run"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at")).drop("place"), "runs")
    able = runs.filter("able").drop("able")
    n_able = able.count()
    drawn = n_able * percent // 100
    n_ranges = max(parallelism(spark), -(-n_able // range_rows))
    every = max(1, n_able // (n_ranges * LOOKS))
    looks = able.filter((F.col("at") + F.pmod(F.hash("run"), F.lit(every))) % every == 0).select("id", "score", "run", "at").toArrow()  # LOOKS rows for each range
    cuts = sorted(k for b in looks.to_batches() for k in _keys(b))[LOOKS::LOOKS]
    parted = _in_ranges(able, cuts)
    counts = np.zeros(len(cuts) + 1, np.int64)
    for part, n in parted.groupBy("part").count().collect():  # a row for each range
        counts[part] = n
    before = np.concatenate([[0], np.cumsum(counts)])
    last = bisect_left(before.tolist(), drawn)  # ranges below it hold the draw

    def merge(batches):
        for part, rows in _ranges(batches):
            wanted = min(int(drawn - before[part]), rows.num_rows)
            starts = [0, *(np.flatnonzero(np.diff(np.asarray(rows["run"]))) + 1).tolist(), rows.num_rows]
            pieces = [((*k, i) for i, k in enumerate(_keys(rows.slice(a, b - a)), a)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            order = np.fromiter((k[-1] for k in Tournament(pieces).take(wanted)), np.int64, wanted)
            rest = np.setdiff1d(np.arange(rows.num_rows), order)
            ranks = pa.concat_arrays([pa.array(before[part] + 1 + np.arange(wanted)), pa.nulls(len(rest), pa.int64())])
            out = rows.take(pa.array(np.concatenate([order, rest])))
            yield pa.RecordBatch.from_arrays([out["id"], out["n_features"], out["weight"], out["score"], ranks], names=["id", "n_features", "weight", "score", "rank"])

    plain = ["id", "n_features", "weight", "score"]
    out = T.StructType([*(runs.schema[c] for c in plain), T.StructField("rank", T.LongType())])
    dealt = parted.filter(F.col("part") < last).repartitionById(max(1, last), F.col("part"))  # a range is a task
    merged = dealt.sortWithinPartitions("part", "run", "at").mapInArrow(merge, out)
    others = parted.filter(F.col("part") >= last).select(*plain).unionByName(runs.filter(~F.col("able")).select(*plain))
    return merged.unionByName(others.withColumn("rank", F.lit(None).cast("long"))).withColumnRenamed("id", id_col)


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``rank`` for the drawn ids alone; a repeated id has a row for each of its rows and ranks. A column
    named rank is replaced."""
    return docs.drop("rank").join(ranks.filter(F.col("rank").isNotNull()).select(id_col, "rank"), id_col)
