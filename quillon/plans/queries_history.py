"""Keyed state, change logs, as-of lookups and health of sources over events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import filters as P
from quillon.operators import health, state
from quillon.plans.queries_listings import CRITERIA
from quillon.plans.tables import RUNS_SQL, SIGHTINGS_SQL, run_log, sightings, table
from quillon.shared import shared_folder
from quillon.sources.listings import gather

#: A moment inside the events' time (21 January 2024), for windows that end then.
NOW = 1_705_795_200


def q_seen_set(spark, sf):
    return state.first_and_last(sightings(spark, sf))


def q_changes(spark, sf):
    return state.changes(sightings(spark, sf)).select("key", "seq", "rent", "previous", "delta", "changed", "is_drop")


def q_change_log(spark, sf):
    return state.change_log(sightings(spark, sf))


def q_notable_drops(spark, sf):
    c = state.changes(sightings(spark, sf)).filter("is_drop")
    return c.select("key", "seq", P.notable_drop(F.col("previous"), F.col("rent"), CRITERIA).alias("notable"), P.crossed_ceiling(F.col("previous"), F.col("rent"), 250).alias("crossed"))


def _moments(spark, sf):
    """Each key asks at noon of every fifth day."""
    keys = sightings(spark, sf).select("key").distinct()
    days = F.explode(F.sequence(F.lit(0), F.lit(25), F.lit(5)))
    return keys.withColumn("d", days).select("key", (F.col("key") * 100 + F.col("d")).alias("moment_id"), (F.lit(1_704_067_200 + 43_200) + F.col("d") * 86_400).cast("long").alias("moment"))


def q_asof_before(spark, sf):
    return state.as_of_before(sightings(spark, sf).filter("rent is not null"), _moments(spark, sf))


def q_asof_after(spark, sf):
    return state.as_of_after(sightings(spark, sf).filter("rent is not null"), _moments(spark, sf))


def q_current_state(spark, sf):
    """Two batches of sightings; those of the second are late in good part, and titles are known to late ones alone."""
    s = sightings(spark, sf).withColumn("url", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("u"), F.col("seq").cast("string"))).otherwise(F.lit("")))
    s = s.withColumn("title", F.when(F.col("seq") % 35 == 0, F.concat(F.lit("t"), F.col("seq").cast("string"))))
    second = F.col("seq") % 7 == 0
    old = s.filter(~second)
    empty = old.limit(0).select("key", "url", "title", "rent", F.col("at_epoch").alias("first_seen"), F.col("at_epoch").alias("seen_epoch"))
    return state.merge_current(state.merge_current(empty, old), s.filter(second))


def q_verdicts(spark, sf):
    """Verdicts of two passes written to the state; the later one's stand, and rows without one keep theirs."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("seen_epoch"))
    known = o.withColumn("tenure", F.when(F.col("key") % 5 == 0, F.lit("PLS")))
    k = F.col("key")
    judged = o.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).filter((k % 3 != 0) & ((F.col("seq") == 1) | (k % 2 == 0)))
    judged = judged.select("key", "seq", F.when(F.col("seq") == 1, "UNKNOWN").otherwise("LLI").alias("tenure"), (F.col("seq") * 40).cast("int").alias("confidence"), F.array(F.concat(F.lit("r"), F.col("seq").cast("string"))).alias("tenure_reasons"))
    out = state.with_verdicts(known, judged)
    return state.stale_verdicts(out, ["UNKNOWN", "LLI"]).select("key", "tenure", "confidence", F.array_join("tenure_reasons", ",").alias("reasons"))


def q_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    old = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    new = o.filter("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    gone = o.filter("o_custkey % 10 = 0").select("o_custkey").distinct()
    return state.delete(state.upsert(old, new, ["o_custkey"]), gone)


def q_point_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    known = table(spark, sf, "customer").filter("c_custkey % 4 <> 0")
    return state.lookup(o, known, "c_custkey", ["c_mktsegment"])


def q_schema_migration(spark, sf):
    old = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return state.migrated(old, {"s_name": F.lit("lost"), "seen_epoch": F.col("s_suppkey") * 60, "tenure": F.lit(None).cast("string")})


def q_harvest_union(spark, sf):
    """Three sources' rows as one, of which the third can't be read (a lazy scan that fails when it runs)."""
    a = lambda: table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = lambda: table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    bad = lambda: table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.raise_error(F.lit("no such page")).cast("string").alias("name"))
    rows, errors = gather({"suppliers": a, "customers": b, "broken": bad})
    return rows.withColumn("failed", F.lit(",".join(source for source, _ in errors)))


def q_event_rows(spark, sf):
    from quillon.sources.sinks import event_rows

    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    judged = o.select(
        F.concat(F.lit("s"), (k % 3 + k % 2).cast("string")).alias("source"), F.element_at(F.array(F.lit("MATCH"), F.lit("DIGEST"), F.lit("REJECT")), (k % 3 + 1).cast("int")).alias("outcome"), F.format_string("o%08d", k).alias("headline"), F.lit("t").alias("text"),
        (k % 5 == 0).alias("high_priority"), (k % 2 == 0).alias("is_new_match"), (k % 7 == 0).alias("rent_drop"),
    )
    return event_rows(judged).withColumn("text", F.md5("text"))


def q_group_history(spark, sf):
    log = state.change_log(sightings(spark, sf))
    members = log.select("key").distinct().withColumn("group_key", F.when(F.col("key") % 4 != 3, F.col("key") % 4))
    return state.group_history(log, members).select("group_key", "key", "rent", "seq", F.col("step").cast("long").alias("step"))


def q_replay(spark, sf):
    return state.replay(_late(spark, sf)).select("key", "seq", "is_new", "is_current", "previous", "delta", "is_drop", "logged")


def q_replay_in_order(spark, sf):
    w = Window.partitionBy("key").orderBy("at_epoch", "seq")
    s = sightings(spark, sf).withColumn("n", F.row_number().over(w).cast("long")).withColumn("seq", F.col("n"))
    return state.replay(s).select("key", "seq", "rent", "previous", "delta", "is_drop")


def _late(spark, sf):
    """Sightings in an arrival order that is not the order of time: every seventh comes late."""
    s = sightings(spark, sf)
    return s.withColumn("seq", F.when(F.col("seq") % 7 == 0, F.col("seq") + 3000).otherwise(F.col("seq")) * 2 + (F.col("seq") % 7 == 0).cast("long"))


def q_stream_sightings(spark, sf):
    """Late sightings, a third of them of one key, landed in three parts with a pass of the stream after each. The second
    pass fails when its batch has been written; the third one judges that batch again."""
    from quillon.streaming.sightings import run_available, watch

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    late = _late(spark, sf).withColumn("key", F.when(F.col("seq") % 3 == 0, F.lit(0)).otherwise(F.col("key")))
    most = late.agg(F.max("seq")).first()[0] or 0
    landed = iter(range(3))
    now = []

    def one_pass():
        part = next(landed)
        now[:] = [part]
        late.filter((F.col("seq") > most * part // 3 - (part == 0)) & (F.col("seq") <= most * (part + 1) // 3)).write.mode("append").parquet(f"{base}/landed")

        def trip(batch, number):
            if now == [1]:
                raise OSError("no channel")

        run_available(spark, f"{base}/landed", "key long, seq long, at_epoch long, rent long", f"{base}/state", f"{base}/out", files_per_batch=None, each=trip)

    errors = []
    done = watch(one_pass, range(3), lambda number, message: errors.append(number))
    judged = spark.read.parquet(f"{base}/out").drop("batch")
    return judged.withColumn("passes", F.lit(done).cast("long")).withColumn("failed", F.lit(",".join(map(str, errors))))


def q_notify_once(spark, sf):
    """Four batches of events of overlapping keys; the second batch meets no channel, so its keys go with later ones."""
    from quillon.streaming.sightings import notify_once

    ledger = f"{shared_folder(spark)}/notified-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents")
    for batch in range(4):
        keys = d.filter(F.col("doc_id") % 4 == batch).select(F.concat("source", F.lit("/"), (F.floor(F.col("doc_id") / 5) % 200).cast("string")).alias("key")).distinct()
        notify_once(keys, ledger, batch, lambda events, number: number != 1)
    return spark.read.schema("key string, batch_id long").parquet(ledger).select("key", "batch_id")


def q_run_log(spark, sf):
    return run_log(spark, sf)


def q_rolling_mean(spark, sf):
    return health.before(run_log(spark, sf)).select("source", "seq", F.round("rolling_mean", 6).alias("rolling_mean"), "last_productive")


def q_source_summary(spark, sf):
    s = health.summary(run_log(spark, sf), NOW)
    return s.select("source", "last_ok", "last_count", "last_success", "last_failure", "ever_produced", "successful_runs", "total_runs", "span", "empty_streak", "runs_in_window", "failed_in_window", "newest")


def _sources(spark):
    return spark.createDataFrame([(f"s{i}",) for i in range(10)], "source string")


def q_health(spark, sf):
    return health.health(run_log(spark, sf), _sources(spark), NOW).select("source", "status", F.round("failure_rate", 6).alias("failure_rate"))


def _alerts(spark):
    return spark.createDataFrame([("s1", "WARN_FLAKY", NOW - 3600), ("s2", "WARN_FLAKY", NOW - 90_000), ("s8", "NEVER_RUN", NOW + 10), ("s3", "BROKEN", NOW - 10)], "source string, status string, at_epoch long")


def q_alert_cooldown(spark, sf):
    states = q_health(spark, sf).select("source", "status")
    return health.due_alerts(states, _alerts(spark), NOW, 24).select("source", "status")


def q_recovery(spark, sf):
    states = q_health(spark, sf).select("source", F.when(F.col("source").isin("s3", "s5"), F.lit("OK")).otherwise(F.col("status")).alias("status"))
    return health.recovered(states, _alerts(spark)).select("source")


def q_heartbeat_due(spark, sf):
    last = run_log(spark, sf).groupBy("source").agg(F.max("at_epoch").alias("last"))
    return last.select("source", health.heartbeat_due(F.when(F.col("source") != "s4", F.col("last")), NOW, 24).alias("due"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_LAG = """changes AS (SELECT *, last_value(rent IGNORE NULLS) OVER (PARTITION BY key ORDER BY at_epoch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM sightings)"""
_MOMENTS = """moments AS (SELECT key, key * 100 + d AS moment_id, CAST(1704067200 + 43200 + d * 86400 AS BIGINT) AS moment FROM (SELECT DISTINCT key FROM sightings) CROSS JOIN (SELECT unnest([0, 5, 10, 15, 20, 25]) AS d))"""
_W = 7 * 86400
_MEAN = f"""before AS (SELECT a.source, a.seq, (SELECT avg(b.item_count) FROM runs b WHERE b.source = a.source AND b.ok AND b.seq < a.seq AND b.at_epoch <= a.at_epoch AND b.at_epoch >= a.at_epoch - {_W}) AS rolling_mean,
    coalesce(last_value(CASE WHEN ok AND item_count > 0 THEN item_count END IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_productive,
    a.item_count, a.ok, a.at_epoch FROM runs a)"""
_SUMMARY = f"""{_MEAN}, tail AS (SELECT source, max(CASE WHEN NOT (ok AND item_count = 0) THEN seq END) AS lo FROM before GROUP BY source),
  marked AS (SELECT b.*, coalesce(seq > lo, true) AS streak FROM before b JOIN tail USING (source)),
  summary AS (SELECT source, arg_max(ok, seq) AS last_ok, arg_max(item_count, seq) AS last_count, arg_max(rolling_mean, seq) AS last_arg, max(CASE WHEN ok THEN at_epoch END) AS last_success, max(CASE WHEN NOT ok THEN at_epoch END) AS last_failure,
    bool_or(ok AND item_count > 0) AS ever_produced, count(*) FILTER (WHERE ok) AS successful_runs, count(*) AS total_runs, max(at_epoch) - min(at_epoch) AS span, count(*) FILTER (WHERE streak) AS empty_streak,
    arg_min(coalesce(rolling_mean, last_productive), seq) FILTER (WHERE streak) AS streak_baseline,
    count(*) FILTER (WHERE at_epoch <= {NOW} AND at_epoch >= {NOW} - {_W}) AS runs_in_window, count(*) FILTER (WHERE NOT ok AND at_epoch <= {NOW} AND at_epoch >= {NOW} - {_W}) AS failed_in_window,
    max(CASE WHEN at_epoch <= {NOW} THEN at_epoch END) AS newest FROM marked GROUP BY source),
  latest AS (SELECT source, rolling_mean FROM before QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) = 1),
  states AS (SELECT s.source, CASE WHEN t.source IS NULL THEN 'NEVER_RUN' WHEN NOT last_ok THEN 'BROKEN' WHEN empty_streak >= 3 AND coalesce(streak_baseline, 0) > 0 THEN 'BROKEN'
    WHEN newest IS NULL OR {NOW} - newest > {_W} THEN 'STALE' WHEN NOT ever_produced AND successful_runs >= 3 AND span >= {_W} THEN 'NEVER_PRODUCED'
    WHEN runs_in_window >= 3 AND failed_in_window * 1.0 / runs_in_window > 0.3 THEN 'WARN_FLAKY' WHEN rolling_mean > 0 AND last_count < rolling_mean * 0.3 THEN 'WARN_DROP' ELSE 'OK' END AS status,
    CASE WHEN runs_in_window > 0 THEN round(failed_in_window * 1.0 / runs_in_window, 6) END AS failure_rate
    FROM (SELECT 's' || i AS source FROM range(10) t(i)) s LEFT JOIN summary t USING (source) LEFT JOIN latest USING (source))"""
_ALERTS = f"alerts(source, status, at_epoch) AS (VALUES ('s1', 'WARN_FLAKY', {NOW} - 3600), ('s2', 'WARN_FLAKY', {NOW} - 90000), ('s8', 'NEVER_RUN', {NOW} + 10), ('s3', 'BROKEN', {NOW} - 10))"

_LATE = """late AS (SELECT key, at_epoch, rent, n FROM (SELECT *, CASE WHEN seq % 7 = 0 THEN seq + 3000 ELSE seq END * 2 + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS n FROM sightings))"""
#: Each sighting of late as it is judged on arrival, one after the other.
_REPLAYED = """s AS (SELECT key, at_epoch, rent, n AS seq, row_number() OVER (PARTITION BY key ORDER BY n) AS k
        FROM late),
      r AS (
        SELECT key, k, seq, rent, true AS is_new, true AS is_current, CAST(NULL AS BIGINT) AS previous, CAST(NULL AS BIGINT) AS delta, rent IS NOT NULL AS logged, at_epoch AS seen, rent AS held,
          CASE WHEN rent IS NOT NULL THEN [{'e': at_epoch, 'n': 0, 'r': rent}] ELSE [] END AS log FROM s WHERE k = 1
        UNION ALL
        SELECT key, k, seq, rent, false, cur, prev, rent - prev, fresh, greatest(seen, at_epoch), CASE WHEN cur THEN coalesce(rent, held) ELSE coalesce(held, rent) END,
          CASE WHEN fresh THEN list_sort(list_append(log, {'e': at_epoch, 'n': len(log), 'r': rent})) ELSE log END
        FROM (SELECT *, CASE WHEN cur THEN held ELSE older END AS prev, rent IS NOT NULL AND rent IS DISTINCT FROM older AND rent IS DISTINCT FROM newer AS fresh
          FROM (SELECT s.key, s.k, s.seq, s.at_epoch, s.rent, r.seen, r.held, r.log, s.at_epoch >= r.seen AS cur,
              list_filter(r.log, lambda x: x.e <= s.at_epoch)[-1].r AS older, list_filter(r.log, lambda x: x.e > s.at_epoch)[1].r AS newer
            FROM r JOIN s ON s.key = r.key AND s.k = r.k + 1))),
      judged AS (SELECT key, seq, rent, is_new, is_current, previous, delta, coalesce(is_current AND delta < 0, false) AS is_drop, logged FROM r)"""

ORACLES = {
    "q_seen_set": f"""WITH {SIGHTINGS_SQL} SELECT key, min(at_epoch) AS first_seen, max(at_epoch) AS last_seen,
      arg_max(rent, at_epoch * 1000000 + seq) FILTER (WHERE rent IS NOT NULL) AS rent, count(*) AS sightings FROM sightings GROUP BY key""",
    "q_changes": f"""WITH {SIGHTINGS_SQL}, {_LAG} SELECT key, seq, rent, previous, rent - previous AS delta, rent IS NOT NULL AND rent IS DISTINCT FROM previous AS changed, coalesce(rent < previous, false) AS is_drop FROM changes""",
    "q_change_log": f"WITH {SIGHTINGS_SQL}, {_LAG} SELECT key, rent, at_epoch, seq FROM changes WHERE rent IS NOT NULL AND rent IS DISTINCT FROM previous",
    "q_notable_drops": f"""WITH {SIGHTINGS_SQL}, {_LAG} SELECT key, seq, previous - rent >= 20 OR (previous > 0 AND (previous - rent) * 100.0 / previous >= 2) AS notable, previous > 250 AND rent <= 250 AS crossed FROM changes WHERE rent < previous""",
    "q_asof_before": f"""WITH {SIGHTINGS_SQL}, {_MOMENTS} SELECT m.key, moment_id, moment, arg_max(rent, at_epoch * 1000000 + seq) AS rent FROM moments m LEFT JOIN sightings s ON s.key = m.key AND s.rent IS NOT NULL AND s.at_epoch <= m.moment GROUP BY ALL""",
    "q_asof_after": f"""WITH {SIGHTINGS_SQL}, {_MOMENTS} SELECT m.key, moment_id, moment, arg_min(rent, at_epoch * 1000000 + seq) AS rent FROM moments m LEFT JOIN sightings s ON s.key = m.key AND s.rent IS NOT NULL AND s.at_epoch > m.moment GROUP BY ALL""",
    "q_current_state": f"""WITH {SIGHTINGS_SQL}, s AS (SELECT *, CASE WHEN seq % 7 = 0 THEN 1000000000 ELSE 0 END + seq AS n, CASE WHEN seq % 3 = 0 THEN 'u' || seq END AS url, CASE WHEN seq % 35 = 0 THEN 't' || seq END AS title FROM sightings),
      j AS (SELECT *, coalesce(at_epoch < max(at_epoch) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM s)
      SELECT key, coalesce(arg_max(url, n) FILTER (WHERE NOT late AND url IS NOT NULL), arg_min(url, n) FILTER (WHERE late AND url IS NOT NULL)) AS url,
      coalesce(arg_max(title, n) FILTER (WHERE NOT late AND title IS NOT NULL), arg_min(title, n) FILTER (WHERE late AND title IS NOT NULL)) AS title,
      coalesce(arg_max(rent, n) FILTER (WHERE NOT late AND rent IS NOT NULL), arg_min(rent, n) FILTER (WHERE late AND rent IS NOT NULL)) AS rent,
      arg_min(at_epoch, n) AS first_seen, max(at_epoch) AS seen_epoch FROM j GROUP BY key""",
    "q_verdicts": """SELECT key, tenure, confidence, reasons FROM (SELECT o_orderkey AS key,
        CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'PLS' END WHEN o_orderkey % 2 = 0 THEN 'LLI' ELSE 'UNKNOWN' END AS tenure,
        CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 80 ELSE 40 END AS INTEGER) AS confidence,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'r2' ELSE 'r1' END AS reasons FROM orders) WHERE tenure IS NULL OR tenure IN ('UNKNOWN', 'LLI')""",
    "q_replay": f"""WITH RECURSIVE {SIGHTINGS_SQL}, {_LATE}, {_REPLAYED}
      SELECT key, seq, is_new, is_current, previous, delta, is_drop, logged FROM judged""",
    "q_stream_sightings": f"""WITH RECURSIVE {SIGHTINGS_SQL}, {_LATE.replace("SELECT key,", "SELECT CASE WHEN n % 3 = 0 THEN 0 ELSE key END AS key,")}, {_REPLAYED}
      SELECT key, seq, is_new, is_current, rent, previous, delta, is_drop, logged, CAST(2 AS BIGINT) AS passes, '1' AS failed FROM judged""",
    "q_notify_once": """SELECT key, min(b) AS batch_id FROM (SELECT source || '/' || ((doc_id // 5) % 200) AS key, doc_id % 4 AS b FROM documents) WHERE b <> 1 GROUP BY key""",
    "q_upsert": "SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN max(o_orderkey) ELSE min(o_orderkey) END AS k FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey",
    "q_point_lookup": "SELECT o_custkey AS c_custkey, o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "q_schema_migration": "SELECT s_suppkey, s_name, s_suppkey * 60 AS seen_epoch, CAST(NULL AS VARCHAR) AS tenure FROM supplier",
    "q_harvest_union": "SELECT s_suppkey AS id, s_name AS name, 'broken' AS failed FROM supplier UNION ALL SELECT c_custkey, c_name, 'broken' FROM customer",
    "q_event_rows": """WITH j AS (SELECT ['MATCH', 'DIGEST', 'REJECT'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS outcome, printf('o%08d', o_orderkey) AS headline, o_orderkey AS k FROM orders),
      d AS (SELECT 's' || (k % 3 + k % 2) AS source, headline, (row_number() OVER (PARTITION BY k % 3 + k % 2 ORDER BY headline) - 1) // 500 AS page FROM j WHERE outcome = 'DIGEST' AND k % 2 = 0)
      SELECT 'match' AS kind, CASE WHEN k % 5 = 0 THEN 5 ELSE 3 END AS priority, headline AS title, md5('t') AS text FROM j WHERE outcome = 'MATCH' AND k % 2 = 0
      UNION ALL SELECT 'rent_drop', 3, headline, md5('t') FROM j WHERE outcome = 'MATCH' AND k % 7 = 0
      UNION ALL SELECT 'digest', 2, 'digest of ' || source || CASE WHEN page > 0 THEN ', ' || (page + 1) ELSE '' END, md5(string_agg(headline, chr(10) ORDER BY headline)) FROM d GROUP BY source, page""",
    "q_group_history": f"""WITH {SIGHTINGS_SQL}, {_LAG} SELECT key % 4 AS group_key, key, rent, seq, row_number() OVER (PARTITION BY key % 4 ORDER BY at_epoch, seq, key) AS step FROM changes WHERE rent IS NOT NULL AND rent IS DISTINCT FROM previous AND key % 4 <> 3""",
    "q_replay_in_order": f"""WITH {SIGHTINGS_SQL}, {_LAG}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_epoch, seq) AS k FROM changes) SELECT key, k AS seq, rent, previous, rent - previous AS delta, coalesce(rent < previous, false) AS is_drop FROM n""",
    "q_run_log": f"WITH {RUNS_SQL} SELECT * FROM runs",
    "q_rolling_mean": f"WITH {RUNS_SQL}, {_MEAN} SELECT source, seq, round(rolling_mean, 6) AS rolling_mean, last_productive FROM before",
    "q_source_summary": f"WITH {RUNS_SQL}, {_SUMMARY} SELECT source, last_ok, last_count, last_success, last_failure, ever_produced, successful_runs, total_runs, span, empty_streak, runs_in_window, failed_in_window, newest FROM summary",
    "q_health": f"WITH {RUNS_SQL}, {_SUMMARY} SELECT source, status, failure_rate FROM states",
    "q_alert_cooldown": f"""WITH {RUNS_SQL}, {_SUMMARY}, {_ALERTS} SELECT s.source, s.status FROM states s LEFT JOIN alerts a ON a.source = s.source AND a.status = s.status
      WHERE s.status <> 'OK' AND (a.at_epoch IS NULL OR a.at_epoch > {NOW} OR {NOW} - a.at_epoch >= 86400)""",
    "q_recovery": f"WITH {RUNS_SQL}, {_SUMMARY}, {_ALERTS} SELECT source FROM states WHERE (status = 'OK' OR source IN ('s3', 's5')) AND source IN (SELECT source FROM alerts)",
    "q_heartbeat_due": f"WITH {RUNS_SQL} SELECT source, source = 's4' OR max(at_epoch) > {NOW} OR {NOW} - max(at_epoch) >= 86400 AS due FROM runs GROUP BY source",
}
