"""Components, places, pairs and clusters against plain versions, in crowds and along chains."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph, resolve

LISTING = "id long, seq long, source string, family string, place_key string, rent int, surface_m2 double, rooms int, floor int"


def smallest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "hub", "chain", "names"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(7, 7), (1_000, 1_000)],
        "hub": [(0 if rng.random() < 0.5 else 5_000, i) for i in range(1, 900)] * 2,
        "chain": [(i, i + 1) for i in rng.sample(range(600), 600)],
        "names": [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(60)],
    }[kind]
    node = "string" if kind == "names" else "long"
    rounds = []
    out = graph.components(spark.createDataFrame([*edges, (None, edges[0][0])], f"a {node}, b {node}"), lambda step, pairs: rounds.append(step))
    assert sorted(map(tuple, out.collect())) == sorted(smallest(edges).items())
    assert len(rounds) <= 12  # the chain of 600 as well
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.randrange(50), i) for i in range(2_000)]
    out = graph.numbered(spark.createDataFrame(rows, "k string, o int, i int").repartition(5), ["k"], [F.desc("o"), F.col("i")])
    want = {}
    for k, o, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        want[i] = sum(1 for v in want.values() if v[0] == k), k
        want[i] = (k, want[i][0])
    assert out.columns == ["k", "o", "i", "place"] and {r.i: (r.k, r.place) for r in out.collect()} == want


def near(a, b, amount, share):
    return abs(a - b) <= amount or max(a, b) > 0 and abs(a - b) <= share * max(a, b)


def same(a, b):
    if a[2] == b[2] or a[3] != b[3] or not a[4] or a[4] != b[4]:
        return False
    told = [None if x is None or y is None else test(x, y) for x, y, test in ((a[5], b[5], lambda x, y: near(x, y, 30, 0.03)), (a[6], b[6], lambda x, y: near(x, y, 2, 0.03)), (a[7], b[7], lambda x, y: x == y), (a[8], b[8], lambda x, y: x == y))]
    return False not in told and sum(x is True for x in told[:3]) >= 2


def greedy(rows):
    held, out = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out[r[0]] = next((h[0] for h in held if same(r, h)), r[0])
        if out[r[0]] == r[0]:
            held.append(r)
    return out


def crowd(rng, n):
    some = lambda x: None if rng.random() < 0.2 else x
    return [
        (i, rng.randrange(n), rng.choice("abc"), rng.choice(["p", "p", "q"]), rng.choice(["paris", "paris", "", None, "lyon"]), some(rng.choice([rng.randrange(940, 1_060), rng.randrange(3_000), 985, 1_015, 0, -5])),
         some(rng.choice([round(rng.uniform(60, 74), 1), round(rng.uniform(5, 200), 2), 64.7, 66.7])), some(rng.randrange(1, 3)), some(rng.randrange(2)))
        for i in range(n)
    ]


def test_pairs_and_clusters_in_a_crowd(spark):
    rows = crowd(random.Random(8), 350)
    df = spark.createDataFrame(rows, LISTING)
    want = sorted((a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if same(a, b))
    assert sorted(map(tuple, resolve.duplicate_pairs(df).collect())) == want and len(want) > 200
    assert {r.id: r.survivor for r in resolve.clusters(df).collect()} == greedy(rows)


def test_tolerances_at_the_edges_of_cells(spark):
    rows = [(i, i, "ab"[i % 2], "p", "x", r, None, 2, None) for i, r in enumerate([*range(960, 1_065), 2_000, 2_060, 2_061, 2_062, 9_700, 10_000, 97_000, 100_000, 100_001])]
    want = sorted((a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if same(a, b))
    assert sorted(map(tuple, resolve.duplicate_pairs(spark.createDataFrame(rows, LISTING)).collect())) == want


def test_a_dense_place_looks_at_wanted_pairs(spark):
    """Two thousand listings of one rent in one place: all alike but for surface, rooms and floor, nearly all of one source."""
    rng = random.Random(2)
    rows = [(i, i, "b" if i % 100 == 0 else "a", "p", "paris", 1_000, float(rng.randrange(20, 200)), rng.randrange(1, 5), rng.randrange(6)) for i in range(2_000)]
    df = spark.createDataFrame(rows, LISTING)
    wanted, looked = resolve.duplicate_pairs(df).count(), resolve.candidate_pairs(df).count()
    assert wanted == sum(same(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :])
    assert looked <= 4 * wanted + len(rows)  # all pairs: 1,999,000


def test_long_chains_of_decisions(spark, monkeypatch):
    """Each listing is one property with the next alone: every second one survives, in a few rounds and one pass."""
    n = 400
    rows = [(i, i, "ab"[i % 2], "p", "x", int(1_000 * 1.02**i), float(i % 2), 3, None) for i in range(n)]
    kept, real = Counter(), resolve.kept
    monkeypatch.setattr(resolve, "kept", lambda df, name: kept.update([name]) or real(df, name))
    found = {r.id: r.survivor for r in resolve.clusters(spark.createDataFrame(rows, LISTING)).collect()}
    assert found == greedy(rows) and found[399] == 398
    assert kept["gone"] == resolve.ROUNDS + 1


def written(monkeypatch, *names):
    """Rows of the tables that resolve writes, by name."""
    rows, real = Counter(), resolve.kept

    def kept(df, name):
        out = real(df, name)
        if name in names:
            rows[name] += out.count()
        return out

    monkeypatch.setattr(resolve, "kept", kept)
    return rows


def test_copies_make_no_more_pairs(spark, monkeypatch):
    """Twelve later copies of each listing are of its kind: the pairs are those of kinds."""
    once = crowd(random.Random(5), 120)
    rows = [(i + 1_000 * k, seq + 1_000 * k, *facts) for k in range(13) for i, seq, *facts in once]
    told = written(monkeypatch, "edges")
    assert {r.id: r.survivor for r in resolve.clusters(spark.createDataFrame(rows, LISTING)).collect()} == greedy(rows)
    assert 0 < told["edges"] <= sum(same(a, b) for i, a in enumerate(once) for b in once[i + 1 :])


def test_pairs_of_a_crowd_grow_with_its_listings(spark, monkeypatch):
    """A place whose listings are all different is decided in steps; each step's pairs are a few for a listing."""
    monkeypatch.setattr(resolve, "FIRST", 50)
    monkeypatch.setattr(resolve, "TIMES", 8)
    rng = random.Random(4)
    rows = [(i, 10_000 - i, rng.choice("abc"), "p", rng.choice(["paris"] * 9 + ["lyon"]), rng.randrange(900, 1_100), round(rng.uniform(60, 70), 3), rng.choice([None, 2]), rng.choice([None, 1])) for i in range(1_500)]
    told = written(monkeypatch, "edges")
    assert {r.id: r.survivor for r in resolve.clusters(spark.createDataFrame(rows, LISTING)).collect()} == greedy(rows)
    pairs = sum(same(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :])
    assert 0 < told["edges"] <= 2 * len(rows) and pairs > 40 * len(rows)


def test_groups_that_chain_over_many_clusters(spark):
    members = spark.createDataFrame([x for c in range(200) for x in ((c, 2 * c, f"m{c}"), (c, 2 * c + 1, f"w{c}"))], "cluster long, seq long, key string")
    groups = spark.createDataFrame([x for c in range(200) for x in ((f"m{c}", f"g{c:03d}"), (f"w{c}", f"g{c + 1:03d}"))], "key string, group_key string")
    rounds = []
    out = resolve.adopt_groups(members, groups, lambda step, pairs: rounds.append(step)).collect()
    assert len(out) == 400 and {r.group_key for r in out} == {"g000"} and len(rounds) <= 9


def test_no_table_of_listings_is_broadcast(spark):
    from conftest import SMALL
    from quillon.plans import queries_listings as Q

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(60).selectExpr("id", "id as seq", "concat('s', id % 3) as source", "'private' as family", "concat('p', id % 4) as place_key", "int(500) as rent", "double(40) as surface_m2", "2 as rooms", "1 as floor")
    assert "BroadcastHashJoin" not in plan(resolve.clusters(rows))
    assert "BroadcastHashJoin" not in plan(resolve.duplicate_pairs(rows))
    assert "BroadcastHashJoin" not in plan(Q._pass(spark, SMALL).members)
