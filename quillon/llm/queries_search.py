"""Queries of exact top-k search and of clustering over the whole embeddings table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.centroids import exponion_clusters
from quillon.llm.common import table
from quillon.llm.topk import top_k


def op1_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion_clusters(table(spark, sf_dir, "embeddings"))


def _clustering_sql(rounds: int = 3) -> str:
    """A pair of queries for each round: the nearest centroid of each vector, and the centroids after it."""
    steps = []
    for step in range(rounds + 1):
        steps.append(f"""a{step} AS (
  SELECT r, arg_min({{'n': n, 'd': d}}, (d, n)) AS best FROM (
    SELECT r, n, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS d FROM v, c{step} c) GROUP BY r
)""")
        if step < rounds:
            steps.append(f"""m{step} AS (
  SELECT n, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS e FROM (
    SELECT best.n AS n, i, CAST(sum(v.e[i]) AS HUGEINT) AS s, count(*) AS k FROM a{step} JOIN v USING (r), range(1, 65) t(i) GROUP BY ALL) GROUP BY n
), c{step + 1} AS (
  SELECT n, coalesce(m.e, c.e) AS e FROM c{step} c LEFT JOIN m{step} m USING (n)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), e) - 1 AS n, e FROM v ORDER BY n LIMIT 16
), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT vec_id, CAST(best.n AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.n) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.n = best.n
"""


QUERIES = {"op1_topk_inner_product": op1_topk_inner_product, "op13_centroid_clustering": op13_centroid_clustering}
ORACLES = {
    "op1_topk_inner_product": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op13_centroid_clustering": _clustering_sql(),
}
