import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillon.operators import health, resolve, state
from quillon.operators.classify import classify
from quillon.operators.state import Ledger, with_profile
from quillon.plans.listing_pass import run_pass
from quillon.operators.filters import Criteria
from quillon.operators.score import Weights
from quillon.schema import EXCLUDED, LISTING, merged_with

PROFILE = "source string, family string, default_tenure string, mixed_tenure boolean"


def listing(**k):
    base = {"source": "a", "external_id": "1", "title": "", "description": "", "fields": {}}
    return tuple((base | k).get(f.name) for f in LISTING)


CASES = [
    ({"title": "Logement intermédiaire T3"}, "LLI", "MATCH"), ({"title": "Appartement PLS"}, "PLS", "REJECT"), ({"description": "logement locatif social"}, "SOCIAL", "REJECT"),
    ({"title": "financement PLUS."}, "PLUS", "REJECT"), ({"title": "PLUS grand que"}, "UNKNOWN", "DIGEST"), ({"fields": {"financement": "PLUS"}}, "PLUS", "REJECT"),
    ({"fields": {"financement": "LLI"}}, "LLI", "MATCH"), ({"title": "LLI", "description": "logement social"}, "UNKNOWN", "DIGEST"), ({"title": "sans commission d'attribution"}, "LLI", "MATCH"),
    ({"title": "commission d'attribution"}, "SOCIAL", "REJECT"), ({"fields": {"other": "HLM"}}, "UNKNOWN", "DIGEST"), ({"title": "LLI", "fields": {"typeLogementSocial": "1"}}, "UNKNOWN", "DIGEST"),
    ({"title": "loyer intermédiaire conventionné"}, "LLI", "MATCH"), ({"title": "x &eacute; LLI"}, "UNKNOWN", "DIGEST"), ({}, "UNKNOWN", "DIGEST"), ({"title": "PLUS ou PLAI"}, "PLUS", "REJECT"),
    ({"title": "LLI", "url": "https://x/hlm/1"}, "UNKNOWN", "DIGEST"), ({"fields": {"financement": "plus"}}, "PLUS", "REJECT"), ({"title": "logement\nintermédiaire"}, "UNKNOWN", "DIGEST"),
]


def test_classify_cases(spark):
    rows = [listing(external_id=str(i), **c[0]) for i, c in enumerate(CASES)]
    profiles = spark.createDataFrame([("a", "institutional", None, True)], PROFILE)
    out = {int(r.external_id): r for r in classify(with_profile(spark.createDataFrame(rows, LISTING), profiles)).collect()}
    assert [(out[i].tenure, out[i].outcome) for i in range(len(CASES))] == [(c[1], c[2]) for c in CASES]
    assert not [r for r in out.values() if r.tenure in EXCLUDED and r.outcome == "MATCH"]
    assert all(r.confidence == 0 or 10 <= r.confidence <= 99 for r in out.values())


def test_source_default_is_too_weak_for_a_mixed_source(spark):
    profiles = spark.createDataFrame([("a", "private", "LIBRE", True), ("b", "private", "LIBRE", False)], PROFILE)
    rows = spark.createDataFrame([listing(), listing(source="b")], LISTING)
    assert {r.source: (r.tenure, r.outcome) for r in classify(with_profile(rows, profiles)).collect()} == {"a": ("UNKNOWN", "DIGEST"), "b": ("LIBRE", "MATCH")}


def model(rows):
    """The ledger's rules over one key, written out plainly."""
    out, ledger = {}, Ledger()
    for seq, at, rent in rows:
        out[seq] = ledger.sight(at, rent)
    return out


def test_replay_of_late_sightings(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(100), rng.choice([None, 100, 200, 300])) for k in range(5) for i in range(30)]
    found = state.replay(spark.createDataFrame(rows, "key long, seq long, at_epoch long, rent long")).collect()
    for k in range(5):
        want = model([(s, a, r) for kk, s, a, r in rows if kk == k])
        assert {r.seq: (r.is_new, r.is_current, r.previous, r.delta, r.is_drop, r.logged) for r in found if r.key == k} == want


def test_ledger_rules():
    x = Ledger()
    assert x.sight(10, 100) == (True, True, None, None, False, True)
    assert x.sight(20, 90) == (False, True, 100, -10, True, True)
    assert x.sight(15, 100) == (False, False, 100, 0, False, False)  # late and unchanged
    assert x.sight(15, 80) == (False, False, 100, -20, False, True)  # late: never a drop
    assert x.rent == 90 and x.seen == 20


def test_stream_keeps_state_between_runs(spark, tmp_path):
    from quillon.streaming.sightings import run_available

    schema = "key long, seq long, at_epoch long, rent long"
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda: run_available(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/cp", f"{tmp_path}/out")
    put([(1, 1, 10, 100)], 1)
    assert run().count() == 1
    put([(1, 2, 20, 90), (1, 3, 5, 100)], 2)
    rows = {r.seq: r for r in run().collect()}
    assert rows[2].is_drop and rows[2].delta == -10 and not rows[3].is_current and not rows[2].is_new


def test_clusters_are_a_partition(spark):
    rng = random.Random(1)
    rows = [(i, i, rng.choice("abc"), "private", rng.choice(["x", "y", "", None]), rng.choice([None, 500, 510, 900]), rng.choice([None, 40.0, 41.0]), rng.choice([None, 2, 3]), rng.choice([None, 0, 1])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, seq long, source string, family string, place_key string, rent int, surface_m2 double, rooms int, floor int")
    out = {r.id: r.survivor for r in resolve.clusters(df).collect()}
    assert sorted(out) == list(range(200)) and len(set(out.values())) < 200

    def near(x, y, absolute, share):
        return abs(x - y) <= absolute or max(x, y) > 0 and abs(x - y) <= share * max(x, y)

    def one(a, b):
        if a[2] == b[2] or not a[4] or a[4] != b[4]:
            return False
        known = [(k, a[k], b[k]) for k in range(5, 9) if a[k] is not None and b[k] is not None]
        same = [(k, near(x, y, 30, 0.03) if k == 5 else near(x, y, 2, 0.03) if k == 6 else x == y) for k, x, y in known]
        return all(ok for _, ok in same) and sum(k < 8 for k, _ in same) >= 2

    survivors, want = [], {}
    for row in rows:
        found = next((s for s in survivors if one(row, s)), None)
        if found is None:
            survivors.append(row)
        want[row[0]] = (found or row)[0]
    assert out == want


def test_duplicate_pairs_find_what_all_pairs_find(spark):
    rng = random.Random(2)
    rows = [(i, i, rng.choice("abc"), "private", "x", rng.choice([None, rng.randrange(2000)]), rng.choice([None, float(rng.randrange(150))]), rng.choice([None, 2, 3]), None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, seq long, source string, family string, place_key string, rent int, surface_m2 double, rooms int, floor int")
    a, b = df.alias("a"), df.alias("b")
    plain = a.join(b, (F.col("a.place_key") == F.col("b.place_key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.source") != F.col("b.source"))).filter(resolve.same_property("a", "b"))
    want = {(r[0], r[1]) for r in plain.select("a.id", "b.id").collect()}
    found = resolve.duplicate_pairs(df).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_health_statuses(spark):
    day = 86_400
    runs = []
    add = lambda s, *log: runs.extend((s, i, at, n, ok, None) for i, (at, n, ok) in enumerate(log))
    add("ok", (0, 5, True), (day, 5, True))
    add("failed", (0, 5, True), (day, 0, False))
    add("empty", (0, 5, True), (1, 0, True), (2, 0, True), (3, 0, True))
    add("never", *[(i * 3 * day, 0, True) for i in range(4)])
    add("flaky", (0, 5, False), (1, 5, False), (2, 5, True))
    add("drop", (0, 100, True), (1, 100, True), (2, 5, True))
    add("back", (10, 7, True), (5, 9, True), (20, 8, True))  # the clock was set back
    df = spark.createDataFrame(runs, "source string, seq long, at_epoch long, item_count long, ok boolean, error string")
    names = spark.createDataFrame([(s,) for s in ("ok", "failed", "empty", "never", "flaky", "drop", "back", "none")], "source string")
    out = {r.source: r for r in health.health(df, names).collect()}
    assert {k: v.status for k, v in out.items()} == {
        "ok": "OK", "failed": "BROKEN", "empty": "BROKEN", "never": "NEVER_PRODUCED", "flaky": "WARN_FLAKY", "drop": "WARN_DROP", "back": "OK", "none": "NEVER_RUN",
    }
    assert out["back"].rolling_mean == 8.0
    late = {r.source: r.status for r in health.health(df, None, 30 * day).collect()}
    assert late["ok"] == "STALE"


def test_run_pass(spark):
    rows = [
        listing(source="a", external_id="1", title="LLI calme", commune="Poissy", postcode="78300", rent_cc=1000, rooms=3, surface_m2=80.0),
        listing(source="b", external_id="2", title="LLI calme", commune="POISSY", postcode="78300", rent_cc=1010, rooms=3, surface_m2=80.0),
        listing(source="a", external_id="3", title="HLM", commune="Poissy", postcode="78300"),
        listing(source="a", external_id="4", title="T3", commune="Lille", postcode="59000"),
        listing(source="a", external_id="5", title="T3", commune="Poissy", postcode="78300"),
    ]
    from pyspark.sql.types import LongType, StructField, StructType

    harvest = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], StructType([*LISTING.fields, StructField("seq", LongType())]))
    profiles = spark.createDataFrame([("a", "institutional", None, True), ("b", "institutional", None, True)], PROFILE)
    known = spark.createDataFrame([("a:id:1", 1200, 0, None)], "key string, rent int, first_seen long, notified_at long")
    out = run_pass(harvest, profiles, known, Criteria(postcode_prefixes=["78"], min_rooms=3), Weights(), 1000)
    judged = {r.external_id: r for r in out.judged.collect()}
    assert {k: v.outcome for k, v in judged.items()} == {"1": "MATCH", "3": "REJECT", "4": "REJECT", "5": "DIGEST"}
    assert judged["1"].rent_drop and judged["1"].is_new_match and "1 200 €" in judged["1"].text
    assert tuple(out.counters.first()) == (2, 0, 5, 4, 1, 1, 1, 2, 2, 1, 0)
    stored = state.with_verdicts(known, out.verdicts).first()
    assert (stored.tenure, stored.rent) == ("LLI", 1200) and stored.confidence > 0 and stored.tenure_reasons


def test_merged_with(spark):
    base = spark.createDataFrame([listing(title="a", url="u", fields={"x": "1", "y": "1"}, rooms=2)], LISTING)
    detail = spark.createDataFrame([listing(title="", description="d", fields={"x": "2"}, rooms=3)], LISTING)
    r = merged_with(base, detail, ["source", "external_id"]).first()
    assert (r.title, r.description, r.url, r.rooms, r.fields) == ("a", "d", "u", 3, {"x": "2", "y": "1"})


def test_within_source_keeps_one_of_a_tie_and_all_without_a_key(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 2, "c"), (None, 1, "d"), (None, 1, "d"), ("m", 5, "e")], "dedup_key string, seq long, title string")
    out = [tuple(r) for r in resolve.within_source(df).collect()]
    assert len(out) == 4 and sum(r[0] is None for r in out) == 2 and ("m", 5, "e") in out and sum(r[:2] == ("k", 1) for r in out) == 1


def test_merge_current_with_late_sightings(spark):
    rng = random.Random(5)
    batches, n = [], 0
    for _ in range(3):
        batches.append([(k, rng.choice([None, "", f"u{n + i}"]), rng.choice(["", f"t{n + i}"]), rng.choice([None, 100 + n + i]), rng.randrange(60), n + i) for i in range(40) for k in [rng.randrange(6)]])
        n += 40
    want = {}
    for key, url, title, rent, at, _ in (row for b in batches for row in b):  # one by one
        if key not in want:
            want[key] = [url or None, title or None, rent, at, at]
            continue
        s = want[key]
        if at >= s[4]:
            s[0], s[1], s[2], s[4] = url or s[0], title or s[1], rent if rent is not None else s[2], at
        else:
            s[0], s[1], s[2] = s[0] or url or None, s[1] or title or None, rent if s[2] is None else s[2]
    out = spark.createDataFrame([], "key long, url string, title string, rent long, first_seen long, seen_epoch long")
    for b in batches:
        out = state.merge_current(out, spark.createDataFrame(b, "key long, url string, title string, rent long, at_epoch long, seq long"))
    assert {r.key: list(r)[1:] for r in out.collect()} == want


def test_rolling_means_with_clocks_set_back(spark):
    rng = random.Random(4)
    runs = [(s, i, rng.randrange(12) * 100_000 if s == "wild" else i * 50_000 - (i % 7 == 0) * 80_000, rng.randrange(5), rng.random() < 0.8, None) for s in ("wild", "mostly") for i in range(60)]
    out = {(r.source, r.seq): r.rolling_mean for r in health.before(spark.createDataFrame(runs, "source string, seq long, at_epoch long, item_count long, ok boolean, error string")).collect()}
    for s, i, at, _, _, _ in runs:
        seen = [n for s2, j, e, n, ok, _ in runs if s2 == s and j < i and ok and at - health.WINDOW <= e <= at]
        assert out[s, i] == (sum(seen) / len(seen) if seen else None)


def test_adopted_groups_chain(spark):
    members = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "b2"), (2, 4, "c"), (3, 5, "x"), (3, 6, "y"), (4, 7, "z")], "cluster long, seq long, key string")
    groups = spark.createDataFrame([("a", "g1"), ("b", "g2"), ("b2", "g2"), ("c", "g3"), ("old", "g3"), ("z", "g9")], "key string, group_key string")
    out = {r.key: r.group_key for r in resolve.adopt_groups(members, groups).collect()}
    assert out == {"a": "g1", "b": "g1", "b2": "g1", "c": "g1", "old": "g1", "x": "x", "y": "x", "z": "g9"}


def test_one_clock_far_ahead_costs_nothing_more(spark):
    """All runs after the one that is years ahead count as set back: each still sees its own seven days."""
    rng = random.Random(6)
    runs = [("s", i, 2_000_000_000 if i == 5 else i * 3_600 - (i % 11 == 0) * 90_000, rng.randrange(9), rng.random() < 0.9, None) for i in range(700)]
    out = {r.seq: r.rolling_mean for r in health.before(spark.createDataFrame(runs, "source string, seq long, at_epoch long, item_count long, ok boolean, error string")).collect()}
    for _, i, at, _, _, _ in runs:
        seen = [n for _, j, e, n, ok, _ in runs if j < i and ok and at - health.WINDOW <= e <= at]
        assert out[i] == (sum(seen) / len(seen) if seen else None)


@pytest.mark.parametrize("block", [1, 3, 64, 500])
def test_earlier_values(block):
    rng = np.random.default_rng(block)
    m, c, v, w = rng.integers(0, 40, 500), rng.integers(0, 2, 500), rng.integers(0, 9, 500), rng.integers(-5, 45, 500)
    v = v * c
    earlier = health.Earlier()
    out = [earlier.take(m[i : i + block], c[i : i + block], v[i : i + block], w[i : i + block]) for i in range(0, 500, block)]
    n, total = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    for i in range(500):
        met = (m[:i] <= w[i]) & (c[:i] > 0)
        assert (n[i], total[i]) == (met.sum(), v[:i][met].sum())
    assert len(earlier.layers) <= 10


def test_a_pass_is_dealt_by_rows_and_not_by_sources(spark, monkeypatch):
    from conftest import SMALL
    from quillon.plans import queries_listings, tables

    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    assert tables.dealt(spark.range(95), "id", 95).rdd.getNumPartitions() == 10
    rows = queries_listings._texts(spark, SMALL)
    assert "Exchange hashpartitioning(source" not in rows._jdf.queryExecution().executedPlan().toString()
    profiles = rows.select("source", "family").distinct().withColumn("mixed_tenure", F.lit(True))
    joined = state.with_profile(rows.drop("family", "mixed_tenure"), profiles)
    assert "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()
