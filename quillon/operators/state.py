"""Keyed state of listings: first and last sightings, current values, a history of changes, as-of lookups."""

from __future__ import annotations

from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_and_last(sightings: DataFrame) -> DataFrame:
    """One row per key of sightings (key, rent, at_epoch, seq): first and last time, current rent, number."""
    return sightings.groupBy("key").agg(
        F.min("at_epoch").alias("first_seen"),
        F.max("at_epoch").alias("last_seen"),
        F.max_by("rent", F.when(F.col("rent").isNotNull(), F.struct("at_epoch", "seq"))).alias("rent"),
        F.count(F.lit(1)).alias("sightings"),
    )


def changes(sightings: DataFrame) -> DataFrame:
    """Sightings that arrived in the order of time, with the rent before (``previous``), ``delta``, and whether the
    rent is new (``changed``) or lower (``is_drop``)."""
    w = Window.partitionBy("key").orderBy("at_epoch", "seq").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last("rent", ignorenulls=True).over(w)
    delta = F.col("rent") - F.col("previous")
    return (
        sightings.withColumn("previous", previous)
        .withColumn("delta", delta)
        .withColumn("changed", F.col("rent").isNotNull() & ~F.col("rent").eqNullSafe(F.col("previous")))
        .withColumn("is_drop", F.coalesce(delta < 0, F.lit(False)))
    )


def change_log(sightings: DataFrame) -> DataFrame:
    return changes(sightings).filter("changed").select("key", "rent", "at_epoch", "seq")


REPLAYED = T.StructType(
    [
        T.StructField("key", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("is_new", T.BooleanType()), T.StructField("is_current", T.BooleanType()),
        T.StructField("rent", T.LongType()), T.StructField("previous", T.LongType()), T.StructField("delta", T.LongType()), T.StructField("is_drop", T.BooleanType()), T.StructField("logged", T.BooleanType()),
    ]
)


class Log:
    """Changes (epoch, number, rent) in the order of time."""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []

    def around(self, epoch: int) -> tuple[int | None, int | None]:
        """The rents that held at a moment, and after it."""
        at = bisect_right(self.rows, (epoch, float("inf")))
        return self.rows[at - 1][2] if at else None, self.rows[at][2] if at < len(self.rows) else None

    def add(self, epoch: int, rent: int) -> None:
        insort(self.rows, (epoch, len(self.rows), rent))


class Ledger:
    """The state of one key, fed in the order of arrival. Its log is kept in the order of time."""

    def __init__(self, seen=None, rent=None, log=None):
        self.seen, self.rent, self.log = seen, rent, log or Log()

    def sight(self, epoch: int, rent: int | None):
        """(is_new, is_current, previous, delta, is_drop, logged) of a sighting."""
        is_new = self.seen is None
        current = is_new or epoch >= self.seen
        before, after = self.log.around(epoch)
        previous = (None if is_new else self.rent) if current else before
        if current:
            self.seen = epoch
            self.rent = rent if rent is not None else self.rent
        elif self.rent is None:
            self.rent = rent
        logged = rent is not None and rent != before and rent != after
        if logged:
            self.log.add(epoch, rent)
        delta = rent - previous if rent is not None and previous is not None else None
        return is_new, current, previous, delta, current and delta is not None and delta < 0, logged


def replay(sightings: DataFrame) -> DataFrame:
    """Every sighting (key, seq, at_epoch, rent) as it was judged when it arrived: late ones never move the state and
    are compared with the rent that held at their time. A key's sightings stream through its ledger in the order of
    arrival, so a worker holds the key's changes, not its sightings."""
    schema = pa.schema([(f.name, pa.bool_() if f.dataType == T.BooleanType() else pa.int64()) for f in REPLAYED])

    def run(batches):
        key, ledger = None, None
        for batch in batches:
            out = []
            for k, seq, epoch, rent in zip(*(batch[c].to_pylist() for c in ("key", "seq", "at_epoch", "rent")), strict=True):
                if ledger is None or k != key:
                    key, ledger = k, Ledger()
                new, current, previous, delta, drop, logged = ledger.sight(epoch, rent)
                out.append((k, seq, new, current, rent, previous, delta, drop, logged))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    rows = sightings.select("key", "seq", "at_epoch", "rent")
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, REPLAYED)


def as_of_before(history: DataFrame, moments: DataFrame) -> DataFrame:
    """moments (key, moment_id, moment) with the last rent of history (key, rent, at_epoch, seq) at or before each.

    Both are sorted together by key and time; no pairs are made.
    """
    both = history.select("key", "at_epoch", F.lit(0).alias("kind"), "seq", "rent", F.lit(None).cast("long").alias("moment_id")).unionByName(
        moments.select("key", F.col("moment").alias("at_epoch"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("long").alias("rent"), "moment_id")
    )
    w = Window.partitionBy("key").orderBy("at_epoch", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rent", F.last("rent", ignorenulls=True).over(w)).filter("kind = 1").select("key", "moment_id", F.col("at_epoch").alias("moment"), "rent")


def as_of_after(history: DataFrame, moments: DataFrame) -> DataFrame:
    """moments with the first rent of history after each."""
    both = history.select("key", "at_epoch", F.lit(1).alias("kind"), "seq", "rent", F.lit(None).cast("long").alias("moment_id")).unionByName(
        moments.select("key", F.col("moment").alias("at_epoch"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("long").alias("rent"), "moment_id")
    )
    w = Window.partitionBy("key").orderBy(F.desc("at_epoch"), F.desc("kind"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rent", F.last("rent", ignorenulls=True).over(w)).filter("kind = 2").select("key", "moment_id", F.col("at_epoch").alias("moment"), "rent")


def merge_current(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State (key, url, title, rent, first_seen, seen_epoch) after a batch of sightings (key, url, title, rent, at_epoch,
    seq: their order of arrival).

    What a sighting says replaces what was known, and what it leaves out stays, unless it is late: older than one that
    arrived before it. A late one fills what is still unknown, and moves no time. first_seen is the first arrival's.
    """
    arrival = Window.partitionBy("key").orderBy("seq", "at_epoch")
    newest = F.max("at_epoch").over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    clean = batch.withColumn("url", F.nullif("url", F.lit(""))).withColumn("title", F.nullif("title", F.lit("")))
    told = clean.join(state.select("key", "seen_epoch"), "key", "left").withColumn("late", F.coalesce(F.col("at_epoch") < F.greatest("seen_epoch", newest), F.lit(False)))
    names = ("url", "title", "rent")
    said = [F.max_by(c, F.when(~F.col("late") & F.col(c).isNotNull(), F.struct("seq", "at_epoch"))).alias(f"n_{c}") for c in names]
    filled = [F.min_by(c, F.when(F.col("late") & F.col(c).isNotNull(), F.struct("seq", "at_epoch"))).alias(f"f_{c}") for c in names]
    news = told.groupBy("key").agg(*said, *filled, F.min_by("at_epoch", F.struct("seq", "at_epoch")).alias("n_first"), F.max("at_epoch").alias("n_seen"))
    return state.join(news, "key", "full").select(
        "key",
        *[F.coalesce(f"n_{c}", F.nullif(c, F.lit("")) if c != "rent" else F.col(c), f"f_{c}").alias(c) for c in names],
        F.coalesce("first_seen", "n_first").alias("first_seen"),
        F.greatest("seen_epoch", "n_seen").alias("seen_epoch"),
    )


VERDICT = ("tenure", "confidence", "tenure_reasons")


def with_verdicts(state: DataFrame, classified: DataFrame) -> DataFrame:
    """State rows (with a key) with the tenure, confidence and tenure_reasons that the latest classification (by seq) of
    their key came to; rows that none was made of keep theirs. :func:`stale_verdicts` reads them."""
    latest = classified.groupBy("key").agg(F.max_by(F.struct(*VERDICT), "seq").alias("__v"))
    lacking = {"tenure": "string", "confidence": "int", "tenure_reasons": "array<string>"}
    full = state.withColumns({c: F.lit(None).cast(k) for c, k in lacking.items() if c not in state.columns})
    return full.join(latest, "key", "left").select(*[F.when(F.col("__v").isNotNull(), F.col("__v")[c]).otherwise(F.col(c)).alias(c) if c in VERDICT else F.col(c) for c in full.columns])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows, which win where keys meet; nulls in keys meet nothing."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns of the table's row of the same key; nulls where there is none."""
    return rows.join(table.select(key, *columns), key, "left")


def migrated(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """table with the columns that a newer schema adds, filled as given, where it lacks them."""
    missing = {k: v for k, v in columns.items() if k not in table.columns}
    return table.withColumns(missing) if missing else table


def not_notified(listings: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """Listings whose key was not notified yet."""
    return listings.join(state.filter(F.col("notified_at").isNotNull()).select(key), key, "left_anti")


def group_history(history: DataFrame, listings: DataFrame) -> DataFrame:
    """The price history of each group, in order: history (key, rent, at_epoch, seq) and listings (key, group_key)."""
    w = Window.partitionBy("group_key").orderBy("at_epoch", "seq", "key")
    return history.join(listings.filter(F.col("group_key").isNotNull()).select("key", "group_key"), "key").withColumn("step", F.row_number().over(w))


def stale_verdicts(listings: DataFrame, tenures: list[str], tenure: str = "tenure") -> DataFrame:
    """Listings whose tenure is missing or one of tenures, the latest seen first."""
    return listings.filter(F.col(tenure).isNull() | F.col(tenure).isin(tenures)).orderBy(F.desc("seen_epoch"), "key")


def age_seconds(first_seen: Column, now_epoch) -> Column:
    return F.greatest(F.lit(0), F.lit(now_epoch) - first_seen)


def with_profile(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """listings with family, default_tenure and mixed_tenure of their source; unknown sources are institutional and
    mixed. Profiles are one row per source and broadcast: by the source, listings would go to a task for each."""
    return (
        listings.join(F.broadcast(profiles), "source", "left")
        .withColumn("family", F.coalesce("family", F.lit("institutional")))
        .withColumn("mixed_tenure", F.coalesce("mixed_tenure", F.lit(True)))
    )
