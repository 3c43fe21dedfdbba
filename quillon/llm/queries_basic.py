"""Queries of sharding, line dedup and resampling over the whole documents table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.line_dedup import line_dedup
from quillon.llm.resampling import importance_ranks
from quillon.llm.sharding import uniform_shards


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = uniform_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_line_dedup": op5_line_dedup, "op8_sharding": op8_sharding, "op11_importance_resampling": op11_importance_resampling}

#: The 32 to 127 range needs no escapes; the blanks are chr(32) and chr(9) to chr(13).
ORACLES = {
    "op5_line_dedup": """
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM cut
), keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT y.doc_id, y.i, y.line, (h.k IS NOT NULL AND y.doc_id < h.keep) AS gone FROM keyed y LEFT JOIN hot h ON y.k = h.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""",
    "op11_importance_resampling": r"""
WITH RECURSIVE texts AS (
  SELECT true AS corpus, doc_id AS id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT false, item_id, row_number() OVER (), coalesce(text, '') FROM benchmark
), found AS (
  SELECT corpus, id, r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT corpus, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM found
), counted AS (
  SELECT corpus, r, f, count(*) AS n FROM features GROUP BY ALL
), bits(b, step, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8
), crc_table AS (SELECT b, v FROM bits WHERE step = 8
), crc(f, h, i, c) AS (
  SELECT f, hex(encode(f)), 0, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT f FROM counted)
  UNION ALL
  SELECT f, h, i + 1, xor(t.v, c >> 8) FROM crc JOIN crc_table t ON t.b = xor(c & 255, CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) WHERE 2 * i < length(h)
), bucketed AS (
  SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * i = length(h)
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE corpus), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT corpus), 0) AS t FROM counted JOIN bucketed USING (f) GROUP BY bucket
), overall AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM totals
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM totals, overall
), sums AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM counted JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE corpus GROUP BY r
), scored AS (
  SELECT id AS doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || CAST(id AS VARCHAR))[1:8] AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM found LEFT JOIN sums USING (r) WHERE corpus
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
""",
}
