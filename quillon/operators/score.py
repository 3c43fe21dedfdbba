"""A weighted score from 0 to 100 with its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import place_key
from quillon.operators.filters import Criteria, is_fresh


@dataclass(frozen=True)
class Weights:
    commune: int = 25
    commute: int = 0
    rent_headroom: int = 15
    surface: int = 10
    lift: int = 15
    high_floor_no_lift: int = -20
    freshness: int = 10

    @property
    def total(self) -> int:
        """What a listing can earn: the penalty doesn't count."""
        return sum(max(0, w) for w in (self.commune, self.commute, self.rent_headroom, self.surface, self.lift, self.freshness))


#: A match of high priority is at least so sure of its tenure.
SURE = 80


def _whole(c: Column) -> Column:
    return F.round(c).cast("int")


def place_points(place: Column, criteria: Criteria, w: Weights) -> Column:
    worst = max([1, *criteria.place_rank.values()])
    if w.commune <= 0:
        return F.lit(0)
    if worst <= 1:
        return F.lit(w.commune)
    ranks = F.create_map(*[F.lit(x) for k, r in criteria.place_rank.items() for x in (k, r)])
    rank = F.coalesce(F.try_element_at(ranks, place_key(place)), F.lit(worst))
    return _whole(F.lit(float(w.commune)) * (F.lit(worst) - rank) / F.lit(float(worst - 1)))


def rent_points(rent: Column, criteria: Criteria, w: Weights) -> Column:
    if w.rent_headroom <= 0 or not criteria.max_rent:
        return F.lit(0)
    room = F.greatest(F.lit(0), F.lit(criteria.max_rent) - rent) / F.lit(float(criteria.max_rent))
    return F.when(rent.isNotNull(), _whole(F.lit(float(w.rent_headroom)) * F.least(F.lit(1.0), room))).otherwise(F.lit(0))


def surface_points(surface: Column, criteria: Criteria, w: Weights) -> Column:
    least = criteria.min_surface_m2 or 0.0
    if w.surface <= 0 or least <= 0:
        return F.lit(0)
    over = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (surface - least) / (least * 0.5)))
    return F.when(surface.isNotNull(), _whole(F.lit(float(w.surface)) * over)).otherwise(F.lit(0))


def floor_points(floor: Column, lift: Column, w: Weights) -> Column:
    low = F.coalesce(floor <= 1, F.lit(False))
    good = low | F.coalesce(lift, F.lit(False))
    bad = ~low & F.coalesce(~lift, F.lit(False)) & floor.isNotNull()
    return F.when(good, F.lit(max(0, w.lift))).otherwise(F.lit(0)) + F.when(bad, F.lit(w.high_floor_no_lift)).otherwise(F.lit(0))


def fresh_points(age_seconds: Column, criteria: Criteria, w: Weights) -> Column:
    return F.when(is_fresh(age_seconds, criteria.freshness_minutes), F.lit(max(0, w.freshness))).otherwise(F.lit(0))


def score(place, rent, surface, floor, lift, age_seconds, criteria: Criteria, w: Weights) -> Column:
    """Points earned, clamped to what can be earned, in percent; 100 where nothing can be earned."""
    if w.total == 0:
        return F.lit(100)
    earned = place_points(place, criteria, w) + rent_points(rent, criteria, w) + surface_points(surface, criteria, w) + floor_points(floor, lift, w) + fresh_points(age_seconds, criteria, w)
    return _whole(F.greatest(F.lit(0), F.least(F.lit(w.total), earned)) * 100.0 / F.lit(float(w.total)))


def high_priority(points: Column, confidence: Column, criteria: Criteria) -> Column:
    return (points >= criteria.high_priority_score) & (confidence >= SURE)


def reasons(tenure_reasons: Column, place, rent, rent_hc, surface, rooms, floor, lift, age_seconds, criteria: Criteria) -> Column:
    """Reason codes in a fixed order, those of the tenure first."""
    found = [
        F.when(place.isNotNull(), F.concat(F.lit("place: "), place)),
        F.when(rent.isNotNull(), F.concat(F.lit("rent: "), rent.cast("string"))).when(rent_hc.isNotNull(), F.lit("rent_without_charges_only")).otherwise(F.lit("rent_unknown")),
        F.when(surface.isNotNull(), F.concat(F.lit("surface: "), surface.cast("string"))).otherwise(F.lit("surface_unknown")),
        F.when(rooms.isNotNull(), F.concat(F.lit("rooms: "), rooms.cast("string"))).otherwise(F.lit("rooms_unknown")),
        F.when(lift, F.lit("lift")).when(floor <= 1, F.lit("low_floor")),
        F.when(~lift & (floor > 1), F.lit("high_floor_without_lift")),
        F.when(is_fresh(age_seconds, criteria.freshness_minutes), F.lit("fresh")),
    ]
    return F.concat(F.coalesce(tenure_reasons, F.array().cast("array<string>")), F.filter(F.array(*found), lambda x: x.isNotNull()))
