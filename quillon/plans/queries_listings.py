"""Filters, scores, resolution and routing of listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.format import facts_line
from quillon.functions.text import dedup_key, place_key
from quillon.operators import filters as P
from quillon.operators import resolve, score, state
from quillon.operators.classify import classify, income_band
from quillon.plans.listing_pass import delivered, run_pass
from quillon.plans.tables import LISTINGS_SQL, dealt, listings, table
from quillon.schema import LISTING
from quillon.shared import shuffled
from quillon.sources.sinks import event_rows

CRITERIA = P.Criteria(
    postcode_prefixes=["75", "78", "92"], min_rooms=3, min_surface_m2=60.0, max_rent=1800, exclude_patterns=["\\bparking\\b", "steel"], exclude_title_patterns=["^promo"],
    place_rank={"france": 1, "germany": 2, "japan": 3, "kenya": 4, "peru": 5},
)
WEIGHTS = score.Weights()
RANKS_SQL = "CASE lower(place) WHEN 'france' THEN 1 WHEN 'germany' THEN 2 WHEN 'japan' THEN 3 WHEN 'kenya' THEN 4 ELSE 5 END"


def q_filter_nullsafe(spark, sf):
    bad = P.below(F.col("rooms"), 3) | P.below(F.col("surface_m2"), 60.0) | P.above(F.col("rent"), 1800)
    return listings(spark, sf).filter(~bad).select("id")


def q_location(spark, sf):
    df = listings(spark, sf)
    named = P.Criteria(places=["france", "germany", "japan"], postcode_prefixes=["75", "78", "92"])
    return df.select("id", P.in_area(F.col("place"), F.col("postcode"), CRITERIA).alias("in_region"), P.in_area(F.col("place"), F.col("postcode"), named).alias("in_list"))


def q_excluded_kind(spark, sf):
    c = P.Criteria(postcode_prefixes=["75"], exclude_title_patterns=["^promo"], exclude_patterns=["steel", "tin"])
    return table(spark, sf, "part").select("p_partkey", P.excluded_by(F.col("p_type"), F.col("p_name"), c).alias("pattern"))


def _reason():
    none = F.lit(None).cast("string")
    return P.disqualifier(F.col("place"), F.col("postcode"), F.col("priority"), none, F.col("rooms"), F.col("surface_m2"), F.col("rent"), CRITERIA)


def q_reject_reason(spark, sf):
    return listings(spark, sf).select("id", _reason().alias("reason"))


def _scored(spark, sf):
    points = score.score(F.col("place"), F.col("rent"), F.col("surface_m2"), F.col("floor"), F.col("lift"), F.col("age"), CRITERIA, WEIGHTS)
    return listings(spark, sf).filter(_reason().isNull()).withColumn("score", points)


def q_score(spark, sf):
    return _scored(spark, sf).select("id", "score", score.high_priority(F.col("score"), F.lit(90), CRITERIA).alias("high_priority"))


def q_topk_ranked(spark, sf):
    return _scored(spark, sf).orderBy(F.desc("score"), "id").limit(100).select("id", "score")


def q_reasons(spark, sf):
    none = F.lit(None)
    r = score.reasons(none.cast("array<string>"), F.col("place"), F.col("rent"), none.cast("int"), none.cast("double"), F.col("rooms"), F.col("floor"), F.col("lift"), F.col("age"), CRITERIA)
    return listings(spark, sf).select("id", F.array_join(r, "|").alias("reasons"))


def q_facts_line(spark, sf):
    return listings(spark, sf).select("id", facts_line(F.col("rooms"), F.col("surface_m2"), F.col("rent")).alias("facts"))


def _entities(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = lambda k, x: F.when(F.col("c_custkey") % k != 0, x)
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("source"), F.lit("private").alias("family"), place_key(F.col("n_name")).alias("place_key"),
        known(9, F.floor(F.abs("c_acctbal") / 4).cast("int")).alias("rent"), known(7, 20 + F.floor(F.abs("c_acctbal")) % 90).cast("double").alias("surface_m2"),
        known(5, (F.col("c_custkey") % 3).cast("int")).alias("rooms"), known(4, (F.col("c_custkey") % 2).cast("int")).alias("floor"),
    )


ENTITIES_SQL = """
e AS (
  SELECT c_custkey AS id, c_mktsegment AS source, n_name AS place,
    CASE WHEN c_custkey % 9 <> 0 THEN CAST(floor(abs(c_acctbal) / 4) AS INTEGER) END AS rent,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST(20 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 90 AS DOUBLE) END AS surface_m2,
    CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 END AS rooms, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 2 END AS floor
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), pairs AS (
  SELECT a.id AS id_a, b.id AS id_b,
    (abs(a.rent - b.rent) <= 30 OR (greatest(a.rent, b.rent) > 0 AND abs(a.rent - b.rent) <= 0.03 * greatest(a.rent, b.rent))) AS r,
    (abs(a.surface_m2 - b.surface_m2) <= 2 OR (greatest(a.surface_m2, b.surface_m2) > 0 AND abs(a.surface_m2 - b.surface_m2) <= 0.03 * greatest(a.surface_m2, b.surface_m2))) AS s,
    a.rooms = b.rooms AS n, a.floor = b.floor AS f
  FROM e a JOIN e b ON a.place = b.place AND a.source <> b.source AND a.id < b.id
)"""


def q_duplicate_pairs(spark, sf):
    return resolve.duplicate_pairs(_entities(spark, sf))


def q_clusters(spark, sf):
    return resolve.clusters(_entities(spark, sf))


def q_group_adoption(spark, sf):
    """Clusters of some customers, groups of others: many clusters meet several groups, and chains of them form."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("k"), k.cast("string"))
    members = c.select(F.floor(k / 4).alias("cluster"), k.alias("seq"), name.alias("key")).filter("seq % 3 <> 0")
    groups = c.filter("c_custkey % 8 in (1, 2, 4)").select(name.alias("key"), F.concat(F.lit("g"), F.lpad(F.floor((k + 5) / 10).cast("string"), 6, "0")).alias("group_key"))
    return resolve.adopt_groups(members, groups)


def q_within_source_dedup(spark, sf):
    """With ties in the order, and documents without a key."""
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("place"), F.when(F.col("doc_id") % 50 != 0, F.concat_ws("|", "source", F.md5("text"))).alias("key"))
    return resolve.within_source(d, "key", "place").select("key", "place")


def q_profile_lookup(spark, sf):
    profiles = spark.createDataFrame([(f"src{i}", "private" if i % 2 else "institutional", "LIBRE" if i % 3 == 0 else None, i % 4 == 0) for i in range(12)], "source string, family string, default_tenure string, mixed_tenure boolean")
    return state.with_profile(table(spark, sf, "documents").select("doc_id", "source"), profiles).select("doc_id", "family", "default_tenure", "mixed_tenure")


#: Titles, fields and more by order, and what they must be classified as, with which confidence and reasons (on a mixed
#: source without a default, unless the source is b, one of free rents alone, or c, mixed with a default).
TEXTS = [
    ({"title": "LLI", "description": "logement social"}, "", "UNKNOWN", 0, "text: lli|conflict|text: logement social"), ({"title": "loyer intermédiaire conventionné"}, "", "LLI", 90, "text: loyer intermediaire"),
    ({"title": "LLI", "url": "https://x/hlm/1"}, "", "UNKNOWN", 0, "check: url|text: lli|conflict"), ({"title": "LLI", "field": "typeLogementSocial"}, "1", "UNKNOWN", 0, "check: name of field typeLogementSocial|text: lli|conflict"),
    ({"field": "other"}, "HLM", "UNKNOWN", 0, "check: field other"), ({"title": "PLUS ou PLAI"}, "", "PLUS", 90, "text: PLUS in context|text: plai"), ({"title": "x &eacute; LLI"}, "", "UNKNOWN", 0, "unreadable text"),
    ({"source": "b"}, "", "LIBRE", 50, "default of the source"), ({"description": "logement locatif social"}, "", "SOCIAL", 90, "text: logement locatif social"), ({}, "plus", "PLUS", 97, "field financement"),
    ({"title": "logement\nintermédiaire"}, "", "UNKNOWN", 0, ""), ("Logement intermédiaire", "", "LLI", 90, "text: logement intermediaire"), ("Appartement PLS", "", "PLS", 90, "text: pls"), ("Résidence HLM", "", "SOCIAL", 90, "text: hlm"),
    ("financement PLUS.", "", "PLUS", 90, "text: PLUS in context"), ("PLUS grand que prévu", "", "UNKNOWN", 0, ""), ("T3", "PLAI", "PLAI", 97, "field financement"), ("LLI", "PLS", "PLS", 82, "field financement|text: lli"),
    ("commission d'attribution", "", "SOCIAL", 80, "procedure: commission d'attribution"), ("sans commission d'attribution", "", "LLI", 80, "procedure: sans commission d'attribution"),
    ("loyers intermédiaires", "", "LLI", 90, "text: loyer intermediaire"), ("T2 calme", "", "UNKNOWN", 0, ""), ("LLI", "hlm?", "SOCIAL", 82, "field financement|text: lli"),
    # financing fields: codes alone, with others, in any case; in prose a doubt, or nothing where it compares
    ("T4", "PLUS CD", "PLUS", 97, "field financement"), ("T4", "PLUS / PLAI", "PLUS", 97, "field financement|field financement"), ("T4", "plai, plus", "PLAI", 97, "field financement|field financement"),
    ("T4", "Prêt PLUS", "UNKNOWN", 0, "field financement"), ("T4", "PLUS|CD", "UNKNOWN", 0, "field financement"), ("T4", "T3 PLUS", "UNKNOWN", 0, "field financement"), ("T4", "appartement de PLUS de 60 m2", "UNKNOWN", 0, ""),
    ("T4", "Logement PLUS.", "PLUS", 97, "field financement"),
    # what other tiers add and take
    ("LLI, attribution directe", "", "LLI", 93, "text: lli|procedure: attribution directe"), ("logement social, commission d'attribution", "", "SOCIAL", 93, "text: logement social|procedure: commission d'attribution"),
    ("badge logement social", "PLAI", "PLAI", 99, "field financement|text: logement social"), ({"source": "c"}, "", "UNKNOWN", 0, "too unsure for a mixed source|default of the source"),
    ("numéro unique d'enregistrement requis", "", "SOCIAL", 80, "procedure: numero unique d'enregistrement|procedure: numero unique"), ("hlm, sans commission d'attribution", "", "SOCIAL", 75, "text: hlm|procedure: sans commission d'attribution"),
]


def _texts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    o = dealt(o, "o_orderkey", o.count())
    at = (F.col("o_orderkey") % len(TEXTS) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    said = [t[0] if isinstance(t[0], dict) else {"title": t[0]} for t in TEXTS]
    value = pick([t[1] for t in TEXTS])
    columns = {k: pick([s.get(k, default) for s in said]) for k, default in (("source", "a"), ("title", ""), ("description", ""), ("url", None))} | {
        "external_id": F.col("o_orderkey").cast("string"), "fields": F.when(value != "", F.create_map(pick([s.get("field", "financement") for s in said]), value)).otherwise(F.create_map().cast("map<string,string>")),
    }
    rows = o.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LISTING])
    profile = spark.createDataFrame([("a", "institutional", None, True), ("b", "private", "LIBRE", False), ("c", "institutional", "LLI", True)], "source string, family string, default_tenure string, mixed_tenure boolean")
    return state.with_profile(rows, profile)


def q_classify(spark, sf):
    return classify(_texts(spark, sf)).select(F.col("external_id").cast("long").alias("id"), "tenure", "outcome", "confidence", F.array_join("tenure_reasons", "|").alias("reasons"))


#: Titles by customer for a whole pass, and what they are classified as.
PASS_TEXTS = [("Logement intermédiaire", "LLI"), ("Appartement PLS", "PLS"), ("T2 calme", "UNKNOWN"), ("LLI neuf", "LLI"), ("Résidence HLM", "SOCIAL")]


def _pass(spark, sf, seed=False):
    """A whole pass over the customers as listings, one source of which failed; some are known, some notified."""
    names = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), "n_name")
    e = dealt(_entities(spark, sf).join(shuffled(names), "id"), "id", table(spark, sf, "customer").count())
    columns = {
        "source": F.col("source"), "external_id": F.col("id").cast("string"), "title": F.element_at(F.array(*[F.lit(t) for t, _ in PASS_TEXTS]), (F.col("id") % len(PASS_TEXTS) + 1).cast("int")), "description": F.lit(""),
        "fields": F.create_map().cast("map<string,string>"), "commune": F.col("n_name"), "postcode": F.when(F.col("id") % 6 != 0, F.lit("75001")).otherwise(F.lit("13001")), "rent_cc": F.col("rent"),
        "surface_m2": F.col("surface_m2"), "rooms": F.col("rooms"), "floor": F.col("floor"),
    }
    harvest = e.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LISTING], F.col("seq").cast("long").alias("seq"))
    profiles = harvest.select("source").distinct().select("source", F.lit("private").alias("family"), F.lit(None).cast("string").alias("default_tenure"), F.lit(True).alias("mixed_tenure"))
    known = e.filter("id % 5 = 0 or id % 4 = 0").select(
        dedup_key(F.col("source"), F.col("id").cast("string"), F.lit(None).cast("string"), F.lit("")).alias("key"), (F.col("rent") + F.when(F.col("id") % 4 == 0, 100).otherwise(0)).cast("int").alias("rent"),
        (F.col("id") % 2000).cast("long").alias("first_seen"), F.when(F.col("id") % 5 == 0, F.lit(1)).alias("notified_at"),
    )
    return run_pass(harvest, profiles, known, P.Criteria(postcode_prefixes=["75"], max_rent=1800, freshness_minutes=10), WEIGHTS, 1_000, seed, errors=[("lost", "OSError: gone")])


def q_pass_counters(spark, sf):
    out = _pass(spark, sf)
    return delivered(out.counters, out.judged.filter("is_new_match or rent_drop"), False)


def q_seed_pass(spark, sf):
    """The pass that only notes what there is: nothing is new and nothing has fallen; ages come from what was known."""
    out = _pass(spark, sf, seed=True)
    age = state.age_seconds(F.col("first_seen"), 1_000)
    told = out.judged.select("id", F.lit("survivor").alias("kind"), age.alias("age"), (F.col("is_new_match") | F.col("rent_drop")).alias("told"), F.array_contains("reasons", "fresh").alias("fresh"))
    noted = out.sightings.groupBy().agg(F.count(F.lit(1)).alias("id")).select("id", F.lit("sightings").alias("kind"), F.lit(None).cast("long").alias("age"), F.lit(None).cast("boolean").alias("told"), F.lit(None).cast("boolean").alias("fresh"))
    return told.unionByName(noted)




def q_income_bands(spark, sf):
    """The tenure whose band holds an income ceiling, where bands are given; without bands none."""
    bands = [("PLAI", 0, 49_999), ("PLUS", 50_000, 99_999), ("PLS", 100_000, 199_999)]
    amount = F.floor("o_totalprice").cast("int")
    return table(spark, sf, "orders").select("o_orderkey", income_band(amount, bands).alias("band"), income_band(amount, []).alias("none"))


def q_existence(spark, sf):
    """Whether there is any row, group by group, and at all."""
    o = table(spark, sf, "orders")
    some = {"any": not o.isEmpty(), "none": not o.filter("o_orderkey < 0").isEmpty()}
    c = table(spark, sf, "customer").select("c_custkey")
    has = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").withColumn("has", F.lit(True))
    return c.join(has, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has"), *[F.lit(v).alias(k) for k, v in some.items()])


def q_stale_verdicts(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select(F.col("doc_id").alias("key"), F.col("n_chars").alias("seen_epoch"), F.when(F.col("quality") == 1, "LLI").when(F.col("quality") == 0, "UNKNOWN").alias("tenure"))
    return state.stale_verdicts(rows, ["UNKNOWN"]).select("key", "tenure")


def q_not_notified(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang")
    sent = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("notified_at"))
    return state.not_notified(d, sent)


def q_digest(spark, sf):
    no = F.lit(False)
    judged = table(spark, sf, "documents").select("source", F.lit("DIGEST").alias("outcome"), F.format_string("%s-%06d", F.col("lang"), F.col("doc_id")).alias("headline"), F.lit("").alias("text"), no.alias("high_priority"), F.lit(True).alias("is_new_match"), no.alias("rent_drop"))
    return event_rows(judged).select("kind", "title", F.md5("text").alias("digest"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_FITS = "(postcode LIKE '75%' OR postcode LIKE '78%' OR postcode LIKE '92%')"
_REASON = f"""CASE WHEN place IS NULL AND postcode IS NULL THEN 'no_location'
    WHEN place IS NOT NULL AND NOT coalesce({_FITS}, false) THEN 'outside_area' WHEN place IS NULL AND NOT coalesce({_FITS}, false) THEN 'outside_area'
    WHEN regexp_matches(lower(priority), '^promo') THEN 'excluded_kind: ^promo'
    WHEN rooms < 3 THEN 'rooms_below_min' WHEN surface_m2 < 60 THEN 'surface_below_min' WHEN rent > 1800 THEN 'rent_above_max' END"""
_SCORED = f"""WITH {LISTINGS_SQL}, judged AS (SELECT *, {_REASON} AS reason FROM listings), scored AS (
  SELECT id, CAST(round(greatest(0, least(75, earned)) * 100.0 / 75.0) AS INTEGER) AS score FROM (
    SELECT id, CAST(round(25.0 * (5 - {RANKS_SQL}) / 4.0) AS INTEGER)
      + CASE WHEN rent IS NOT NULL THEN CAST(round(15.0 * least(1.0, greatest(0, 1800 - rent) / 1800.0)) AS INTEGER) ELSE 0 END
      + CASE WHEN surface_m2 IS NOT NULL THEN CAST(round(10.0 * least(1.0, greatest(0.0, (surface_m2 - 60) / 30.0))) AS INTEGER) ELSE 0 END
      + CASE WHEN coalesce(floor <= 1, false) OR coalesce(lift, false) THEN 15 ELSE 0 END
      + CASE WHEN NOT coalesce(floor <= 1, false) AND coalesce(NOT lift, false) AND floor IS NOT NULL THEN -20 ELSE 0 END
      + CASE WHEN age IS NULL OR age <= 3600 THEN 10 ELSE 0 END AS earned
    FROM judged WHERE reason IS NULL))"""
_AGREED = "coalesce(r, true) AND coalesce(s, true) AND coalesce(n, true) AND coalesce(f, true) AND CAST(coalesce(r, false) AS INTEGER) + CAST(coalesce(s, false) AS INTEGER) + CAST(coalesce(n, false) AS INTEGER) >= 2"
#: Greedy clusters, place by place in the order of ids.
_CLUSTERS = f"""WITH RECURSIVE {ENTITIES_SQL}, before AS (SELECT id_b AS id, list(id_a) AS earlier FROM pairs WHERE {_AGREED} GROUP BY id_b),
  numbered AS (SELECT e.id, e.place, row_number() OVER (PARTITION BY place ORDER BY e.id) AS k, coalesce(earlier, []) AS earlier FROM e LEFT JOIN before ON before.id = e.id),
  walked AS (
    SELECT DISTINCT place, CAST(0 AS BIGINT) AS k, CAST([] AS INT64[]) AS held, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS survivor FROM e
    UNION ALL
    SELECT place, k, CASE WHEN met IS NULL THEN list_append(held, id) ELSE held END, id, coalesce(met, id)
    FROM (SELECT n.place, n.k, n.id, w.held, list_min(list_intersect(w.held, CAST(n.earlier AS INT64[]))) AS met FROM walked w JOIN numbered n ON n.place = w.place AND n.k = w.k + 1)
  ), clusters AS (SELECT id, survivor FROM walked WHERE k > 0)"""
_WANTED = [f"({i}, '{t}', {n}, '" + why.replace("'", "''") + "')" for i, (_, _, t, n, why) in enumerate(TEXTS)]
_OUTCOME = "CASE WHEN tenure IN ('LLI', 'LIBRE') THEN 'MATCH' WHEN tenure = 'UNKNOWN' THEN 'DIGEST' ELSE 'REJECT' END"

ORACLES = {
    "q_filter_nullsafe": f"WITH {LISTINGS_SQL} SELECT id FROM listings WHERE NOT coalesce(rooms < 3, false) AND NOT coalesce(surface_m2 < 60, false) AND NOT coalesce(rent > 1800, false)",
    "q_location": f"""WITH {LISTINGS_SQL} SELECT id, coalesce({_FITS}, false) AS in_region,
      CASE WHEN place IS NULL THEN coalesce({_FITS}, false) ELSE lower(place) IN ('france','germany','japan') AND (postcode IS NULL OR {_FITS}) END AS in_list FROM listings""",
    "q_excluded_kind": """SELECT p_partkey, CASE WHEN lower(p_type) LIKE 'promo%' THEN '^promo' WHEN lower(p_type || chr(10) || p_name) LIKE '%steel%' THEN 'steel'
      WHEN lower(p_type || chr(10) || p_name) LIKE '%tin%' THEN 'tin' END AS pattern FROM part""",
    "q_reject_reason": f"WITH {LISTINGS_SQL} SELECT id, {_REASON} AS reason FROM listings",
    "q_score": f"{_SCORED} SELECT id, score, score >= 70 AS high_priority FROM scored",
    "q_topk_ranked": f"{_SCORED} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 100",
    "q_reasons": f"""WITH {LISTINGS_SQL} SELECT id, concat_ws('|', 'place: ' || place, CASE WHEN rent IS NOT NULL THEN 'rent: ' || rent ELSE 'rent_unknown' END, 'surface_unknown',
      CASE WHEN rooms IS NOT NULL THEN 'rooms: ' || rooms ELSE 'rooms_unknown' END, CASE WHEN lift THEN 'lift' WHEN floor <= 1 THEN 'low_floor' END,
      CASE WHEN NOT lift AND floor > 1 THEN 'high_floor_without_lift' END, CASE WHEN age IS NULL OR age <= 3600 THEN 'fresh' END) AS reasons FROM listings""",
    "q_facts_line": f"""WITH {LISTINGS_SQL} SELECT id, concat_ws(' · ', CASE WHEN rooms IS NOT NULL THEN rooms || ' rooms' END,
      CASE WHEN surface_m2 IS NOT NULL THEN regexp_replace(replace(printf('%.1f', CAST(surface_m2 AS DOUBLE)), '.', ','), ',0$', '') || ' m²' END,
      CASE WHEN rent IS NOT NULL THEN replace(format('{{:,}}', rent), ',', ' ') || ' €' END) AS facts FROM listings""",
    "q_duplicate_pairs": f"WITH {ENTITIES_SQL} SELECT id_a, id_b FROM pairs WHERE {_AGREED}",
    "q_within_source_dedup": """WITH d AS (SELECT doc_id // 3 AS place, CASE WHEN doc_id % 50 <> 0 THEN source || '|' || md5(text) END AS key FROM documents)
      SELECT key, min(place) AS place FROM d WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT key, place FROM d WHERE key IS NULL""",
    "q_clusters": f"{_CLUSTERS} SELECT id, survivor FROM clusters",
    "q_pass_counters": f"""{_CLUSTERS}, judged AS (SELECT id, rent, CASE WHEN id % 6 = 0 OR coalesce(rent > 1800, false) THEN 'REJECT' ELSE ['MATCH', 'REJECT', 'DIGEST', 'MATCH', 'REJECT'][CAST(id % 5 + 1 AS INTEGER)] END AS outcome
      FROM clusters JOIN e USING (id) WHERE id = survivor), marked AS (SELECT *, outcome <> 'REJECT' AND id % 5 <> 0 AS fresh, outcome = 'MATCH' AND id % 4 = 0 AND rent IS NOT NULL AS fell FROM judged)
      SELECT (SELECT count(DISTINCT source) FROM e) + 1 AS sources_run, CAST(1 AS BIGINT) AS sources_failed, (SELECT count(*) FROM e) AS items, count(*) AS clusters, (SELECT count(*) FROM e) - count(*) AS duplicates,
        count(*) FILTER (WHERE outcome = 'MATCH') AS matches, count(*) FILTER (WHERE outcome = 'DIGEST') AS digests, count(*) FILTER (WHERE outcome = 'REJECT') AS rejects,
        count(*) FILTER (WHERE fresh) AS new, count(*) FILTER (WHERE fell) AS drops, count(*) FILTER (WHERE fresh OR fell) AS undelivered FROM marked""",
    "q_seed_pass": f"""{_CLUSTERS}, known AS (SELECT id, CASE WHEN id % 5 = 0 OR id % 4 = 0 THEN greatest(0, 1000 - id % 2000) ELSE 0 END AS age FROM clusters WHERE id = survivor)
      SELECT id, 'survivor' AS kind, age, false AS told, age <= 600 AS fresh FROM known UNION ALL SELECT count(*), 'sightings', NULL, NULL, NULL FROM e""",
    "q_income_bands": """SELECT o_orderkey, CASE WHEN floor(o_totalprice) <= 49999 THEN 'PLAI' WHEN floor(o_totalprice) <= 99999 THEN 'PLUS' WHEN floor(o_totalprice) <= 199999 THEN 'PLS' END AS band, CAST(NULL AS VARCHAR) AS none FROM orders""",
    "q_existence": 'SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has, (SELECT count(*) > 0 FROM orders) AS "any", false AS none FROM customer',
    "q_group_adoption": """WITH RECURSIVE m AS (SELECT c_custkey // 4 AS cluster, c_custkey AS seq, 'k' || c_custkey AS key FROM customer WHERE c_custkey % 3 <> 0),
      g AS (SELECT 'k' || c_custkey AS key, 'g' || lpad(CAST((c_custkey + 5) // 10 AS VARCHAR), 6, '0') AS group_key FROM customer WHERE c_custkey % 8 IN (1, 2, 4)),
      known AS (SELECT m.*, group_key FROM m LEFT JOIN g USING (key) WHERE cluster IN (SELECT cluster FROM m GROUP BY cluster HAVING count(*) > 1)),
      adopted AS (SELECT cluster, coalesce(arg_min(group_key, seq) FILTER (WHERE group_key IS NOT NULL), arg_min(key, seq)) AS name FROM known GROUP BY cluster),
      links AS (SELECT DISTINCT group_key AS a, name AS b FROM known JOIN adopted USING (cluster) WHERE group_key IS NOT NULL),
      edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
      reach AS (SELECT a, a AS b FROM edges UNION SELECT r.a, x.b FROM reach r JOIN edges x ON r.b = x.a),
      final AS (SELECT r.a, min(r.b) AS name FROM reach r WHERE r.b IN (SELECT b FROM links) GROUP BY r.a)
      SELECT key, coalesce(name, group_key) AS group_key FROM g LEFT JOIN final ON a = group_key
      UNION ALL SELECT key, coalesce(final.name, adopted.name) FROM known JOIN adopted USING (cluster) LEFT JOIN final ON final.a = adopted.name WHERE group_key IS NULL""",
    "q_profile_lookup": """SELECT doc_id, CASE WHEN i < 12 AND i % 2 = 1 THEN 'private' ELSE 'institutional' END AS family, CASE WHEN i < 12 AND i % 3 = 0 THEN 'LIBRE' END AS default_tenure,
      CASE WHEN i < 12 THEN i % 4 = 0 ELSE true END AS mixed_tenure FROM (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS i FROM documents)""",
    "q_classify": f"""SELECT o_orderkey AS id, tenure, {_OUTCOME} AS outcome, CAST(confidence AS INTEGER) AS confidence, reasons
      FROM orders JOIN (VALUES {", ".join(_WANTED)}) w(k, tenure, confidence, reasons) ON k = o_orderkey % {len(TEXTS)}""",
    "q_stale_verdicts": """SELECT doc_id AS key, tenure FROM (SELECT d.doc_id, CASE WHEN quality = 1 THEN 'LLI' WHEN quality = 0 THEN 'UNKNOWN' END AS tenure FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
      WHERE tenure IS NULL OR tenure = 'UNKNOWN'""",
    "q_not_notified": "SELECT doc_id AS key, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "q_digest": """SELECT 'digest' AS kind, 'digest of ' || source || CASE WHEN page > 0 THEN ', ' || (page + 1) ELSE '' END AS title, md5(string_agg(line, chr(10) ORDER BY line)) AS digest
      FROM (SELECT source, line, (row_number() OVER (PARTITION BY source ORDER BY line) - 1) // 500 AS page FROM (SELECT source, printf('%s-%06d', lang, doc_id) AS line FROM documents)) GROUP BY source, page""",
}
