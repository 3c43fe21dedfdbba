"""Exact top-k search by inner product: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

The second moments of all vectors give a rotation (their singular vectors) after which the first few coordinates hold
most of an inner product; the rest is at most the product of the residual lengths. Candidates are dealt into bands of
descending length, and a band into parts of some thousand rows (bands of one common length too). The longest vectors
of all give each query a first threshold; queries whose thresholds reach as many bands are grouped, and a band's
candidates go to those groups alone that reach it. In a cell (a group of queries and a part of a band) chunks of
candidates are bounded by their partial sums, and the exact product is computed for those that can still enter the
query's top k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import written

#: Rotated coordinates in the partial sums.
HEAD = 16
#: Longest vectors that give the first thresholds, and bands of length, at most.
SEEDS, MAX_BANDS = 1_024, 1_024
CHUNK = 2_048
EXACT = float(1 << 53)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, factor: float, asks: Column) -> DataFrame:
    """id, v (floor(factor * x) of each component), norm, and whether the row asks; without rows whose vector is null or holds a null or
    non-finite component, or whose id is null."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * factor)).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))
    )


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of int64, filled with zeros to dim."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.asarray(column.offsets, dtype=np.int64)
    flat = np.asarray(column.values, dtype=np.int64)
    lengths = np.diff(at)
    if (lengths == dim).all():
        return flat[at[0] : at[-1]].reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    for i in np.flatnonzero(lengths):
        out[i, : lengths[i]] = flat[at[i] : at[i + 1]]
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of q and c, as int64 (clipped to its range)."""
    reach = float(np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0) * (c.astype(float) ** 2).sum(1).max(initial=0)))
    if reach < EXACT:  # then so are all partial sums: doubles hold them exactly
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ c.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_cell(q_ids, q, least, c_ids, c, k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, candidate id, score) of each query's k best candidates of this cell with a score of at
    least ``least``; an id is not its own candidate."""
    qr, cr = q.astype(float) @ rotation, c.astype(float) @ rotation
    h = min(HEAD, qr.shape[1])
    q_rest, c_rest = np.sqrt((qr[:, h:] ** 2).sum(1)), np.sqrt((cr[:, h:] ** 2).sum(1))
    q_norm, c_norm = np.sqrt((qr**2).sum(1)), np.sqrt((cr**2).sum(1))
    order = np.lexsort((c_ids, -c_norm))
    limit = np.where(np.isnan(least), -np.inf, least)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for at in range(0, len(order), CHUNK):
        part = order[at : at + CHUNK]
        slack = 1e-9 * (1 + q_norm * c_norm[part[0]])  # of the rotation's rounding
        live = np.flatnonzero(q_norm * c_norm[part[0]] + slack >= limit)
        if not len(live):
            break  # no shorter vector can do better
        bound = qr[live, :h] @ cr[part, :h].T + q_rest[live, None] * c_rest[None, part] + slack[live, None]
        able = bound >= limit[live, None]
        if able.mean() > 0.05:
            s = products(q[live], c[part])
            able &= q_ids[live, None] != c_ids[None, part]
            if s.shape[1] > k:
                kth = np.partition(np.where(able, s.astype(float), -np.inf), -k, axis=1)[:, -k]
                able &= s >= np.maximum(kth - np.abs(kth) * 1e-15, -EXACT * EXACT)[:, None]
            i, j = np.nonzero(able)
            score = s[i, j]
        else:
            i, j = np.nonzero(able & (q_ids[live, None] != c_ids[None, part]))
            a, b = q[live[i]], c[part[j]]
            if float(q_norm.max() * c_norm[part[0]]) < EXACT:
                score = np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
            else:
                score = np.clip((a.astype(object) * b.astype(object)).sum(1), -(1 << 63), (1 << 63) - 1).astype(np.int64)
        i, ids = live[i], c_ids[part[j]]
        i, ids, score = (np.concatenate(x) for x in zip(best, (i, ids, score), strict=True))
        keep = np.lexsort((ids, -score, i))
        i, ids, score = i[keep], ids[keep], score[keep]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        top = (place < k) & (score >= limit[i])
        best = i[top], ids[top], score[top]
        last = place == k - 1
        limit[i[last]] = np.maximum(limit[i[last]], score[last].astype(float) * (1 - np.sign(score[last]) * 1e-15))
    return best


def levels(reaches: dict[int, int], query_rows: int) -> tuple[dict[int, int], dict[int, int]]:
    """Queries by how many bands they reach, joined to levels of at least query_rows queries, the last one aside: the
    level (the largest reach in it) of each reach, and the queries of each level."""
    level, counts, joined = {}, {}, []
    for reach in sorted(reaches):
        joined.append(reach)
        if sum(reaches[r] for r in joined) >= query_rows or reach == max(reaches):
            level |= dict.fromkeys(joined, reach)
            counts[reach] = sum(reaches[r] for r in joined)
            joined = []
    return level, counts or {1: 1}


def rotation_of(vectors: DataFrame, dim: int) -> np.ndarray:
    """Singular vectors of all rows, the strongest first: dim x dim, from sums that each partition makes beforehand."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch["v"], dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim), pa.int32()), pa.array(np.tile(np.arange(dim), dim), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    out = np.zeros((dim, dim))
    for i, j, s in vectors.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        out[i, j] = s
    return np.linalg.svd(out)[0]


def top_k(
    df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0, query_rows: int = 2_048, band_rows: int = 8_192
) -> DataFrame:
    """The k rows of largest inner product for each row of df for which the Column ``is_query`` holds: query_id, rank
    (from 1), id_col, score. Ties go to the smaller id; a query gets all others if they are fewer than k.

    Components are floor(factor * x), products exact 64-bit integers. Rows whose id or vector is null, or whose vector
    has a null or non-finite component, take no part; missing components of shorter vectors count as 0. Rows with a
    query's id are never its answers; of query rows that repeat an id the smallest vector asks. Repeated candidates
    are answers as often as they occur. An empty table gives no rows.
    """
    spark = df.sparkSession
    asks = is_query if isinstance(is_query, Column) else F.expr(is_query)
    vectors = written(whole_vectors(df, id_col, vector_col, factor, asks), "vectors")  # read several times
    rows, dim, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("norm")).first()
    out = f"query_id long, `{id_col}` long, score long"
    if not rows or not dim:
        dim = 1
    rotation = spark.sparkContext.broadcast(rotation_of(vectors, dim) if rows else np.eye(1))
    queries = vectors.filter("asks").groupBy("id").agg(F.min("v").alias("v"), F.min_by("norm", "v").alias("norm"))
    seeds = vectors.orderBy(F.desc("norm"), "id").limit(SEEDS).select("id", "v").toArrow()  # SEEDS rows
    seeded = spark.sparkContext.broadcast((np.asarray(seeds["id"], dtype=np.int64), _matrix(seeds["v"], dim)))

    def first_threshold(batches):
        ids, matrix = seeded.value
        for batch in batches:
            q_ids, q = np.asarray(batch["id"], dtype=np.int64), _matrix(batch["v"], dim)
            least = np.full(len(q), np.nan)
            for at in range(0, len(q), CHUNK):
                s = products(q[at : at + CHUNK], matrix).astype(float)
                s[q_ids[at : at + CHUNK, None] == ids[None, :]] = -np.inf
                if s.shape[1] >= k:
                    kth = np.partition(s, -k, axis=1)[:, -k]
                    least[at : at + CHUNK] = np.where(np.isfinite(kth), kth - np.abs(kth) * 1e-15, np.nan)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, from_pandas=True)], names=["id", "v", "norm", "least"])

    bands = int(min(MAX_BANDS, max(1, -(-(rows or 0) // band_rows))))
    cuts = sorted(vectors.approxQuantile("norm", [b / bands for b in range(1, bands)], 0.2 / bands) if bands > 1 and rows else [], reverse=True)
    tops = F.array(*[F.lit(float(x) * (1 + 1e-9)) for x in [longest or 0.0, *cuts]])  # the largest norm of each band
    band = F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), lambda x: x > F.col("norm")))
    reach = F.size(F.filter(tops, lambda top: F.col("least").isNull() | (top * F.col("norm") + 1e-6 * F.abs("least") + 1 >= F.col("least"))))
    # of each band: its rows, hence its parts, so that no cell grows with the table (MAX_BANDS numbers)
    sizes = dict(vectors.groupBy(band.alias("band")).count().collect())
    splits = F.array(*[F.lit(max(1, -(-sizes.get(b, 0) // band_rows))) for b in range(bands)])
    bounded = written(queries.mapInArrow(first_threshold, "id long, v array<long>, norm double, least double").withColumn("reach", F.greatest(reach, F.lit(1))), "queries")
    level, counts = levels(dict(bounded.groupBy("reach").count().collect()), query_rows)  # MAX_BANDS numbers
    own = F.array(*[F.lit(level.get(r, r)) for r in range(1, bands + 1)])
    parts = F.array(*[F.lit(-(-counts.get(r, 1) // query_rows)) for r in range(1, bands + 1)])
    grouped = bounded.withColumn("level", F.get(own, F.col("reach") - 1)).withColumn("g", F.pmod(F.xxhash64("id"), F.get(parts, F.col("level") - 1)).cast("int"))
    asked = grouped.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("reach") - 1))).withColumn("split", F.explode(F.sequence(F.lit(0), F.get(splits, F.col("band")) - 1)))
    # the groups that a band's candidates go to: those of levels that reach it
    reached = F.array(*[F.struct(F.lit(r).alias("level"), F.lit(-(-n // query_rows)).alias("parts")) for r, n in sorted(counts.items())])
    held = vectors.withColumn("band", band).withColumn("split", F.pmod(F.xxhash64("id", "v"), F.get(splits, F.col("band"))).cast("int"))
    held = held.withColumn("to", F.explode(F.filter(reached, lambda x: x["level"] > F.col("band")))).select("id", "v", "band", "split", "to.level", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1)).alias("g"))
    names = ["query_id", id_col, "score"]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids = np.asarray(left["id"], dtype=np.int64)
        if not len(left) or not len(right):
            found = (np.zeros(0, np.int64),) * 3
        else:
            least = left["least"].to_numpy().astype(float)
            found = search_cell(q_ids, _matrix(left["v"], dim), least, np.asarray(right["id"], dtype=np.int64), _matrix(right["v"], dim), k, rotation.value)
        return pa.table([pa.array(q_ids[found[0]]), pa.array(found[1]), pa.array(found[2])], names=names)

    key = ["level", "g", "band", "split"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(cell, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
