"""Views of the benchmark tables as listings, sightings and run logs, in Spark and in SQL, with nulls made on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df for work that takes long for a row: if its scan has fewer tasks than the session has cores (a small table of few
    row groups), its rows are dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a task whose work takes a good part of a millisecond for a row.
TASK_ROWS = 100_000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df, of so many rows, dealt out by a key to all of the session's cores, and to tasks of TASK_ROWS rows at most,
    about: a task's time stays the same however large the table is."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), key)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, spread."""
    return spread(table(spark, sf_dir, name))


#: Two digits of postcodes, dealt by customer.
PREFIXES = ["75", "77", "78", "91", "92", "93", "94", "95"]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings: id, place, postcode, rent, rooms, surface_m2, floor, lift, age; a part of each is unknown."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("l_quantity").alias("q"))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    known = lambda k, c: F.when(F.col("o_orderkey") % k != 0, c)
    code = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("o_custkey") % 8 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        known(13, F.col("n_name")).alias("place"),
        known(17, F.concat(code, F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))).alias("postcode"),
        known(11, F.floor(F.col("o_totalprice") / 150).cast("int")).alias("rent"),
        known(7, F.col("n")).alias("rooms"),
        known(5, F.col("q")).alias("surface_m2"),
        known(3, (F.col("o_orderkey") % 9).cast("int")).alias("floor"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(True)).when(F.col("o_orderkey") % 4 == 1, F.lit(False)).alias("lift"),
        known(19, (F.col("o_orderkey") % 120) * 60).alias("age"),
        F.col("o_orderpriority").alias("priority"),
    )


LISTINGS_SQL = """
li AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
listings AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 13 <> 0 THEN n_name END AS place,
    CASE WHEN o_orderkey % 17 <> 0 THEN ['75','77','78','91','92','93','94','95'][CAST(o_custkey % 8 + 1 AS INTEGER)] || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') END AS postcode,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice / 150) AS INTEGER) END AS rent,
    CASE WHEN o_orderkey % 7 <> 0 THEN n END AS rooms,
    CASE WHEN o_orderkey % 5 <> 0 THEN q END AS surface_m2,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 9 AS INTEGER) END AS floor,
    CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN false END AS lift,
    CASE WHEN o_orderkey % 19 <> 0 THEN (o_orderkey % 120) * 60 END AS age,
    o_orderpriority AS priority
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings: key, seq, at_epoch, rent (unknown in a part); failed polls are left out."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return e.select(
        F.col("user_id").cast("long").alias("key"),
        F.col("event_id").cast("long").alias("seq"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_epoch"),
        F.when(F.col("event_id") % 10 != 0, F.floor(F.col("value") / 25).cast("long") * 25).alias("rent"),
    )


SIGHTINGS_SQL = """
sightings AS (
  SELECT CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS at_epoch,
    CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value / 25) AS BIGINT) * 25 END AS rent
  FROM events WHERE event_type <> 'error'
)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls: a run of a source (user_id mod 8) an hour; ok unless a fifth of its events or more are errors."""
    e = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    runs = e.groupBy((F.col("user_id") % 8).alias("k"), hour.alias("hour")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("item_count"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n")
    )
    ok = F.col("errors") * 5 < F.col("n")
    return runs.select(
        F.concat(F.lit("s"), F.col("k").cast("string")).alias("source"),
        F.unix_timestamp("hour").alias("seq"),
        F.unix_timestamp("hour").alias("at_epoch"),
        F.col("item_count"),
        ok.alias("ok"),
        F.when(~ok, F.concat(F.col("errors").cast("string"), F.lit(" errors"))).alias("error"),
    )


RUNS_SQL = """
runs AS (
  SELECT 's' || CAST(k AS VARCHAR) AS source, CAST(epoch(hour) AS BIGINT) AS seq, CAST(epoch(hour) AS BIGINT) AS at_epoch, item_count, errors * 5 < n AS ok,
    CASE WHEN NOT (errors * 5 < n) THEN CAST(errors AS VARCHAR) || ' errors' END AS error
  FROM (SELECT user_id % 8 AS k, date_trunc('hour', ts) AS hour, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS item_count,
          CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, count(*) AS n FROM events GROUP BY 1, 2)
)"""
