"""One pass over harvested listings: classify, cluster, judge, score and route, and the state after it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.format import digest_text, drop_text, headline
from quillon.functions.text import dedup_key, place_key
from quillon.operators import filters, resolve, score, state
from quillon.operators.classify import classify
from quillon.operators.filters import Criteria
from quillon.operators.score import Weights
from quillon.schema import effective_rent
from quillon.shared import kept, shuffled


@dataclass
class Pass:
    judged: DataFrame  # survivors with outcome, score, reasons, what is new and what fell
    sightings: DataFrame  # every member as a sighting (key, url, title, rent, at_epoch, seq)
    members: DataFrame  # cluster, seq, key
    verdicts: DataFrame  # key, seq, tenure, confidence, tenure_reasons of every member, for state.with_verdicts
    counters: DataFrame  # one row


def run_pass(harvest: DataFrame, profiles: DataFrame, known: DataFrame, criteria: Criteria, weights: Weights, now_epoch: int, seed: bool = False, errors: list[tuple[str, str]] | None = None) -> Pass:
    """harvest: listing rows with ``seq``, their order of arrival. known: key, rent, first_seen, notified_at of listings
    seen before. With ``seed`` everything is noted and nothing is new. ``errors``: of sources that failed (source,
    message), as listings.gather returns them.

    Classification needs no other row, so it comes before the shuffle by place that clustering needs.
    """
    rent = effective_rent(F.col("rent_cc"), F.col("rent_hc"), F.col("charges"))
    listed = state.with_profile(harvest, profiles).withColumn("key", dedup_key(F.col("source"), F.col("external_id"), F.col("url"), F.col("title"))).withColumn("rent", rent)
    listed = listed.withColumn("place_key", place_key(F.col("commune"))).withColumn("id", F.col("seq").cast("long"))
    classified = kept(classify(listed), "classified")  # judged, verdicts and counters read it
    found = resolve.clusters(classified.select("id", "seq", "source", "family", "place_key", "rent", "surface_m2", "rooms", "floor"))
    found = shuffled(kept(found, "found"))  # survivors, members and counters read it
    before = shuffled(known.select("key", F.col("rent").alias("previous"), "first_seen", "notified_at"))
    survivors = classified.join(found.filter("id = survivor").select("id"), "id").join(before, "key", "left")
    reason = filters.disqualifier(*[F.col(c) for c in ("commune", "postcode", "title", "description", "rooms", "surface_m2", "rent")], criteria)
    age = state.age_seconds(F.col("first_seen"), now_epoch)
    judged = (
        survivors.withColumn("disqualifier", reason)
        .withColumn("tenure_outcome", F.col("outcome"))
        .withColumn("outcome", filters.outcome(F.col("tenure_outcome"), F.col("disqualifier")))
        .withColumn("score", F.when(F.col("outcome") == "MATCH", score.score(*[F.col(c) for c in ("commune", "rent", "surface_m2", "floor", "has_elevator")], age, criteria, weights)))
        .withColumn("high_priority", F.coalesce(score.high_priority(F.col("score"), F.col("confidence"), criteria), F.lit(False)))
        .withColumn("reasons", score.reasons(*[F.col(c) for c in ("tenure_reasons", "commune", "rent", "rent_hc", "surface_m2", "rooms", "floor", "has_elevator")], age, criteria))
        .withColumn("is_new_match", F.lit(not seed) & F.col("notified_at").isNull() & F.col("outcome").isin("MATCH", "DIGEST"))
        .withColumn("rent_drop", F.lit(not seed) & (F.col("outcome") == "MATCH") & (filters.notable_drop(F.col("previous"), F.col("rent"), criteria) | filters.crossed_ceiling(F.col("previous"), F.col("rent"), criteria.max_rent)))
        .withColumn("headline", headline(F.col("title"), F.col("commune"), F.col("rooms"), F.col("surface_m2"), F.col("rent")))
        .withColumn("text", F.when(F.col("rent_drop"), drop_text(F.col("previous"), F.col("rent"))).otherwise(digest_text(F.col("reasons"))))
    )
    sightings = classified.select("key", "url", "title", "rent", F.lit(now_epoch).cast("long").alias("at_epoch"), "seq")
    members = found.join(classified.select("id", "seq", "key"), "id").select(F.col("survivor").alias("cluster"), "seq", "key")
    harvested = classified.agg(F.count_distinct("source").alias("answered"), F.count(F.lit(1)).alias("items"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counted = judged.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("outcome") == "MATCH").alias("matches"), F.count_if(F.col("outcome") == "DIGEST").alias("digests"), F.count_if(F.col("outcome") == "REJECT").alias("rejects"),
        F.count_if("is_new_match").alias("new"), F.count_if("rent_drop").alias("drops"),
    )
    failed = len({source for source, _ in errors or []})
    both = harvested.unionByName(counted, allowMissingColumns=True)
    counters = both.agg(*map(total, both.columns)).select(
        (F.col("answered") + failed).alias("sources_run"), F.lit(failed).cast("long").alias("sources_failed"), "items", "clusters", (F.col("items") - F.col("clusters")).alias("duplicates"),
        "matches", "digests", "rejects", "new", "drops", F.lit(0).cast("long").alias("undelivered"),
    )
    verdicts = classified.select("key", "seq", *state.VERDICT)
    return Pass(judged, sightings, members, verdicts, counters)


def delivered(counters: DataFrame, events: DataFrame, sent: bool) -> DataFrame:
    """counters with the events that no channel took as ``undelivered``."""
    return counters.withColumn("undelivered", F.lit(0 if sent else events.count()).cast("long"))
