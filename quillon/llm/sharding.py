"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. The rows are written with a number each. What follows works on hashes of number and content alone, so that equal rows
   spread like others; the hashes fall into virtual source partitions, which are counted.
2. A matrix is drawn: how many rows of each partition go to each shard. Its rows are multivariate
   hypergeometric draws without replacement from the shards' free places, so that its margins are the partitions'
   counts and the exact shard sizes, as under a uniformly random permutation.
3. Each partition is permuted locally; the first a[p, 0] rows go to shard 0, the next a[p, 1] to shard 1, ...
4. After the exchange each shard is permuted again, in buckets of a second random key, so that no task holds a whole
   shard.
5. The rows themselves are exchanged once: each meets its shard and slot by its number.

Numbers are written before they are used, so a lost executor's tasks give the same rows again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import written

#: Virtual source partitions at most, and numbers of the matrix (sources x shards, one row of it aside) that the driver
#: draws and broadcasts.
MAX_SOURCES, MAX_CELLS = 65_536, 1 << 20
#: Buckets of all shards at most: bounds the table of their starts, which is broadcast.
MAX_BUCKETS = 262_144
#: Populations that numpy draws from.
NUMPY_LIMIT = 10**9


def exact_sizes(rows: int, shards: int) -> np.ndarray:
    """Shard sizes that differ by one at most, the larger ones first."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of sample rows, drawn without replacement, are among the good ones; the same exact law at any size.

    Beyond numpy's limit by inversion: neighbouring counts have a rational ratio of probabilities, so logarithms are
    summed from the mode outwards, over 12 standard deviations (what lies beyond has less than 10^-30)."""
    if good < NUMPY_LIMIT and bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    low, high = max(0, sample - bad), min(sample, good)
    share = good / total
    reach = int(12 * np.sqrt(sample * share * (1 - share))) + 64
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)  # the ratio of k + 1 to k
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    chance = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(chance - chance.max()))
    return low + min(int(np.searchsorted(chance, rng.random() * chance[-1], side="right")), high - low)


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows of each source (``counts``) to each shard (``sizes``), drawn as a random permutation would."""
    rng = np.random.default_rng(seed)
    free = np.asarray(sizes, np.int64).copy()
    out = np.zeros((len(counts), len(free)), np.int64)
    for p, n in enumerate(counts):
        if int(free.sum()) < NUMPY_LIMIT:  # the same law, drawn at once
            out[p] = rng.multivariate_hypergeometric(free, int(n), method="marginals")
            free -= out[p]
            continue
        left, rest = int(free.sum()), int(n)
        for j in range(len(free)):
            if not rest:
                break
            other = left - int(free[j])
            take = hypergeometric(rng, int(free[j]), other, rest) if left else 0
            out[p, j], left, rest = take, other, rest - take
        free -= out[p]
    return out


def uniform_shards(df: DataFrame, shards: int = 16, seed: int = 8, source_rows: int = 1_024, bucket_rows: int = 2_048) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), a uniformly random order.

    Shard sizes differ by one row at most. Null values in any column, empty and long texts and repeated rows are rows like
    others; ties of a hash go by the other hash, then by the row's number. The order depends on the seed, on the content
    and on how df's rows lie in partitions. An empty table gives no rows. Columns of df named shard or slot are
    replaced; names that start with ``__`` are reserved.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    content = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    held = written(df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__k", F.xxhash64(F.lit(seed), "__at", *content)), "rows")
    rows = held.count()
    sources = int(min(MAX_SOURCES, max(1, MAX_CELLS // shards), max(1, -(-rows // source_rows))))
    buckets = int(max(1, min(MAX_BUCKETS // shards, -(-rows // (shards * bucket_rows)))))
    keys = held.select("__at", "__k", F.pmod("__k", F.lit(sources)).cast("int").alias("__p"))
    counts = dict(keys.groupBy("__p").count().collect())  # one number for each source, MAX_SOURCES at most
    matrix = communication_matrix([counts.get(p, 0) for p in range(sources)], exact_sizes(rows, shards), seed)
    ends = spark.createDataFrame(
        [(p, row.tolist()) for p, row in enumerate(np.cumsum(matrix, axis=1))],
        T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))]),
    )
    local = Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed + 1), "__k"), "__k", "__at")
    dealt = written(
        keys.withColumn("__r", F.row_number().over(local).cast("long"))
        .join(F.broadcast(ends), "__p")  # MAX_CELLS numbers
        .select(
            "__at", "__k", F.size(F.filter("__ends", lambda end: end < F.col("__r"))).alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 3), "__k"), F.lit(buckets)).cast("int").alias("__b")
        ),
        "dealt",
    )
    sized = dealt.groupBy("shard", "__b").count()  # MAX_BUCKETS rows at most
    starts = sized.withColumn("__start", F.sum("count").over(Window.partitionBy("shard").orderBy("__b")) - F.col("count")).drop("count")
    again = Window.partitionBy("shard", "__b").orderBy(F.xxhash64(F.lit(seed + 2), "__k"), "__k", "__at")
    slots = dealt.withColumn("__i", F.row_number().over(again).cast("long")).join(F.broadcast(starts), ["shard", "__b"]).select("__at", "shard", (F.col("__start") + F.col("__i") - 1).alias("slot"))
    return held.drop("__k").join(slots, "__at").select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
