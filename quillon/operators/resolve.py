"""Entity resolution: listings of several sources that are one property."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.graph import components, numbered
from quillon.shared import kept, shuffled

# Tolerances of rent (euros, share) and surface (square metres, share), facts that must agree.
RENT_EUROS, RENT_SHARE, SURFACE_M2, SURFACE_SHARE, FACTS = 30.0, 0.03, 2.0, 0.03, 2


def within(a: Column, b: Column, absolute: float, share: float) -> Column:
    """Whether two numbers differ by at most an amount, or a share of the larger; null if either is unknown."""
    gap = F.abs(a - b)
    return (gap <= absolute) | (F.greatest(a, b) > 0) & (gap <= share * F.greatest(a, b))


def same_property(a: str, b: str) -> Column:
    """Whether rows a and b (aliases; rent, surface_m2, rooms, floor) agree on enough facts and differ on none."""
    pair = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    rent, surface = within(*pair("rent"), RENT_EUROS, RENT_SHARE), within(*pair("surface_m2"), SURFACE_M2, SURFACE_SHARE)
    rooms, floor = pair("rooms")[0] == pair("rooms")[1], pair("floor")[0] == pair("floor")[1]
    veto = F.coalesce(~rent, F.lit(False)) | F.coalesce(~surface, F.lit(False)) | F.coalesce(~rooms, F.lit(False)) | F.coalesce(~floor, F.lit(False))
    facts = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (rent, surface, rooms)), F.lit(0))
    return ~veto & (facts >= FACTS)


#: Facts of a listing, each with what it takes to differ by a cell at most: tolerances, or None for equality.
_FACTS = {"rent": (RENT_EUROS, RENT_SHARE), "surface_m2": (SURFACE_M2, SURFACE_SHARE), "rooms": None, "floor": None}


def _cell(c: str) -> Column:
    """The cell of a number: numbers that agree lie in one cell or in neighbouring ones. Cells are as wide as the
    tolerance or wider: the amount decides below the turn, the share above it."""
    if _FACTS[c] is None:
        return F.col(c).cast("long")
    absolute, share = _FACTS[c]
    turn, wider = absolute / share, 1 + 1e-9  # than the rounding of a logarithm
    x = F.col(c).cast("double")
    high = F.floor(F.log(x / turn) / (-F.log(F.lit(1 - share)) * wider)) + F.lit(int(turn / absolute))
    return F.when(x < turn, F.floor(x / (absolute * wider))).otherwise(high).cast("long")


def candidate_pairs(listings: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """Pairs of listings (structs a and b; first and second, the sets of facts that they know) that are looked at. With
    ``later``, a is one of listings and b one of those.

    Two listings meet on the facts that both know: in neighbouring cells of rent and surface, and equal rooms and floor.
    Which facts those are depends on both (16 sets at most), so a listing asks for each set that partners have, and it
    asks only for sources other than its own that have listings there. Pairs that are looked at are then wanted ones but
    for the cells' width, in a dense place too.
    """
    facts = list(_FACTS)
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(facts)), F.lit(0))
    placed = lambda df: df.filter(_placed()).select("id", "source", "family", "place_key", *facts, *[_cell(c).alias(f"__{c}") for c in facts], mask.alias("mask"))
    rows = placed(listings)
    others = rows if later is None else placed(later)
    masks = sorted({r.mask for df in ([rows] if later is None else [rows, others]) for r in df.select("mask").distinct().collect()})  # 16 at most
    enough = lambda m: bin(m & 0b111).count("1") >= FACTS
    partners = lambda fits: F.create_map(*[x for own in masks for x in (F.lit(own), F.array(*[F.lit(m) for m in masks if fits(own, m) and enough(own & m)]).cast("array<int>"))])
    place = ["family", "place_key", "first", "second", *[f"__{c}" for c in facts]]
    both = F.col("first").bitwiseAND(F.col("second"))
    shared = lambda i, c: F.when(both.bitwiseAND(1 << i) != 0, c)
    if not any(enough(m) for m in masks):
        none = F.struct("id", *facts)
        return rows.limit(0).select(F.col("mask").alias("first"), F.col("mask").alias("second"), none.alias("a"), none.alias("b"))
    # the one with the smaller set of facts asks, or the one that is not later
    asking = rows.withColumn("first", F.col("mask")).withColumn("second", F.explode(partners(lambda own, m: later is not None or m >= own)[F.col("mask")]))
    asked = others.withColumn("second", F.col("mask")).withColumn("first", F.explode(partners(lambda own, m: later is not None or m <= own)[F.col("mask")]))
    for i, c in enumerate(facts):
        cell = F.col(f"__{c}")
        near = F.array(cell) if _FACTS[c] is None else F.array(cell - 1, cell, cell + 1)
        asking = asking.withColumn(f"__{c}", F.explode(F.when(both.bitwiseAND(1 << i) != 0, near).otherwise(F.array(F.lit(-(1 << 40))))))
        asked = asked.withColumn(f"__{c}", F.coalesce(shared(i, cell), F.lit(-(1 << 40))))
    there = asked.select(*place, F.col("source").alias("other")).distinct()
    named = asking.withColumnsRenamed({c: f"a_{c}" for c in ("id", "source", *facts)}).drop("mask")
    sought = named.join(shuffled(there), place).filter(F.col("a_source") != F.col("other"))
    met = sought.join(shuffled(asked.withColumnRenamed("source", "other")), [*place, "other"])
    struct = lambda prefix: F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("id", *facts)])
    once = F.lit(True) if later is not None else (F.col("first") < F.col("second")) | (F.col("a_id") < F.col("id"))
    return met.filter(once).select("first", "second", struct("a_").alias("a"), struct("").alias("b"))


def _placed() -> Column:
    return F.col("place_key").isNotNull() & (F.col("place_key") != "")


def duplicate_pairs(listings: DataFrame) -> DataFrame:
    """Pairs (id_a < id_b) of different sources that are one property. listings: id, source, family, place_key, rent,
    surface_m2, rooms, floor."""
    pairs = candidate_pairs(listings).filter(same_property("a", "b"))
    return pairs.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


#: Rounds in which all that can be decided is; what is left then is decided component by component.
ROUNDS = 6
#: Kinds of listings of a place that are decided first, and how many times as many are decided by each step.
FIRST, TIMES = 1_000, 8


def _in_order(edges: DataFrame) -> DataFrame:
    """The late ones that join an early one, of edges (early, late, early_at, late_at) whose components are decided one
    by one: in the order of arrival, a listing is absorbed by any earlier partner that is not absorbed itself."""
    pieces = components(edges.select(F.col("early").alias("a"), F.col("late").alias("b")))
    told = edges.join(shuffled(pieces.select(F.col("node").alias("late"), "component")), "late")

    def decide(batches):
        component, gone = None, set()
        for batch in batches:
            out = []
            for c, early, late in zip(*(batch[n].to_pylist() for n in ("component", "early", "late")), strict=True):
                if c != component:
                    component, gone = c, set()
                if early not in gone and late not in gone:
                    gone.add(late)
                    out.append(late)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field("late").type)], names=["late"])

    ordered = told.repartition("component").sortWithinPartitions("component", "late_at", "early_at").select("component", "early", "late")
    return ordered.mapInArrow(decide, T.StructType([T.StructField("late", edges.schema["late"].dataType)]))


def _absorbed(kinds: DataFrame) -> DataFrame | None:
    """(late, survivor) of kinds that others of them absorb; None if there are none. A kind is named by its ``id``, the
    struct of order and id of its first listing.

    First in ROUNDS rounds over all pairs at once: a kind survives once no earlier partner is undecided or survives,
    and its later partners are absorbed. In a crowd that decides nearly all. What is left are chains of decisions: their
    components are found, and each is decided in one sorted pass, holding its absorbed kinds.
    """
    told = duplicate_pairs(kinds)
    edges = kept(told.select(*[F.col(f"{x}.id").alias(n) for x, n in (("id_a", "early"), ("id_b", "late"))], F.col("id_a").alias("early_at"), F.col("id_b").alias("late_at")), "edges")
    left, absorbed = edges, []
    for step in range(ROUNDS + 1):
        if left.isEmpty():
            break
        if step == ROUNDS:
            absorbed.append(kept(_in_order(left), "gone"))
            break
        waiting = left.select(F.col("late").alias("early")).distinct()
        gone = kept(left.join(shuffled(waiting), "early", "left_anti").select("late").distinct(), "gone")  # their early partner survives
        absorbed.append(gone)
        left = kept(left.join(shuffled(gone), "late", "left_anti").join(shuffled(gone.withColumnRenamed("late", "early")), "early", "left_anti"), "left")
    if not absorbed:
        return None
    lost = shuffled(reduce(DataFrame.unionByName, absorbed))
    survivors = edges.join(lost.withColumnRenamed("late", "early"), "early", "left_anti")
    return kept(survivors.join(lost, "late", "left_semi").groupBy("late").agg(F.min("early_at").alias("survivor")), "absorbed")


def clusters(listings: DataFrame, order: str = "seq") -> DataFrame:
    """(id, survivor): greedily in the order of arrival, a listing joins the first survivor that it is one property
    with, or becomes a survivor. Survivors alone are compared; rows without a place stand alone.

    Listings of one source, place and equal facts are one kind, and share what becomes of them: if the first joins a
    survivor, all others find the same one first; if it survives, no partner of theirs does. So kinds are decided, by
    their first listings, and what is decided grows with the kinds, not with their listings.

    In a crowd the pairs of kinds would grow with the square of a place. A place's first kinds are decided before
    others, then what they absorb goes, then as many times TIMES are decided of what is left, and so on: what comes late
    and is left has few partners among the others, or it would have met a survivor. So pairs grow with the kinds, unless
    facts follow the order of arrival.
    """
    alike = ["source", "family", "place_key", *_FACTS]
    known = sum((F.col(c).isNotNull().cast("int") for c in list(_FACTS)[:3]), F.lit(0))
    partnered = listings.filter(_placed() & F.col("id").isNotNull() & F.col("source").isNotNull() & (known >= FACTS))
    kinds = kept(partnered.groupBy(*alike).agg(F.min(F.struct(F.col(order).alias("at"), F.col("id").alias("id"))).alias("id")), "kinds")
    most = kinds.groupBy("family", "place_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bounds = [FIRST]
    while bounds[-1] < most:
        bounds.append(bounds[-1] * TIMES)
    left, absorbed = kinds, []
    if len(bounds) > 1:
        step = sum(((F.col("place") >= b).cast("int") for b in bounds), F.lit(0))
        left = kept(numbered(kinds, ["family", "place_key"], [F.col("id")]).withColumn("step", step).drop("place"), "left")
    for step in range(len(bounds)):
        now = left.filter(F.col("step") == step) if len(bounds) > 1 else left
        gone = _absorbed(now)
        absorbed += [gone] if gone else []
        if step == len(bounds) - 1:
            break
        if gone:
            now = now.join(shuffled(gone.select(F.col("late").alias("gone"))), F.col("id.id") == F.col("gone"), "left_anti")
        rest = left.filter(F.col("step") > step)
        met = candidate_pairs(kept(now, "first"), rest).filter(same_property("a", "b"))
        gone = kept(met.groupBy(F.col("b.id.id").alias("late")).agg(F.min("a.id").alias("survivor")), "absorbed")
        absorbed.append(gone)
        left = kept(rest.join(shuffled(gone.select(F.col("late").alias("gone"))), F.col("id.id") == F.col("gone"), "left_anti"), "left")
    own = F.col("id").cast("long")
    if not absorbed:
        return listings.select(own.alias("id"), own.alias("survivor"))
    lost = shuffled(reduce(DataFrame.unionByName, absorbed).select("late", F.col("survivor.id").alias("survivor")))
    lost = kinds.join(lost, F.col("id.id") == F.col("late")).select(*[F.col(c).alias(f"k_{c}") for c in alike], "survivor")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in alike])
    found = listings.select("id", *alike).join(shuffled(lost), same, "left")
    return found.select(own.alias("id"), F.coalesce("survivor", "id").cast("long").alias("survivor"))


def within_source(listings: DataFrame, key: str = "dedup_key", order: str = "seq") -> DataFrame:
    """The first listing of each key; of several with the same order one (by a hash of all columns). Listings without a
    key stand alone. Tasks choose among their own rows before anything is exchanged."""
    content = [c for c, kind in listings.dtypes if not kind.startswith(("map", "variant"))]
    once = listings.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*listings.columns), F.struct(order, F.xxhash64(*content))).alias("__row")).select("__row.*")
    return once.unionByName(listings.filter(F.col(key).isNull()))


def adopt_groups(members: DataFrame, groups: DataFrame, each: Callable[[int, DataFrame], None] = lambda step, pairs: None) -> DataFrame:
    """Groups after a batch of clusters. members: cluster, seq, key; groups: key, group_key (a key's group so far).

    A cluster of two or more takes its first member's group that exists, else its first member's key; keys of the
    other groups it meets follow. Where clusters chain over groups, all of the chain take the smallest of their names:
    chains are components of the graph of groups that one cluster joins. ``each`` is told of that search's rounds.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    known = members.join(sizes, "cluster", "left_semi").join(groups, "key", "left")
    adopted = known.groupBy("cluster").agg(F.coalesce(F.min_by("group_key", F.when(F.col("group_key").isNotNull(), F.col("seq"))), F.min_by("key", "seq")).alias("into"))
    moved = kept(known.join(adopted, "cluster"), "moved")
    met = moved.filter(F.col("group_key").isNotNull()).select(F.col("group_key").alias("a"), F.col("into").alias("b")).distinct()
    chains = kept(components(met, each), "chains")
    names = chains.join(met.select(F.col("b").alias("node")).distinct(), "node", "left_semi").groupBy("component").agg(F.min("node").alias("into"))
    final = chains.join(names, "component").select(F.col("node").alias("name"), "into")
    old = groups.join(final, groups["group_key"] == final["name"], "left").select("key", F.coalesce("into", "group_key").alias("group_key"))
    new = moved.filter(F.col("group_key").isNull()).select("key", F.col("into").alias("name")).join(final, "name", "left")
    return old.unionByName(new.groupBy("key").agg(F.min(F.coalesce("into", "name")).alias("group_key")))
