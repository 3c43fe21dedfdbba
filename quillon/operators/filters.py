"""Hard disqualifiers, evaluated in order; what is unknown never disqualifies."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import fold, place_key


@dataclass(frozen=True)
class Criteria:
    """What is looked for. Nulls and empty lists mean "any"."""

    places: list[str] = field(default_factory=list)
    postcode_prefixes: list[str] = field(default_factory=list)
    min_rooms: int | None = None
    min_surface_m2: float | None = None
    max_rent: int | None = None
    exclude_patterns: list[str] = field(default_factory=list)
    exclude_title_patterns: list[str] = field(default_factory=list)
    place_rank: dict[str, int] = field(default_factory=dict)
    freshness_minutes: int = 60
    high_priority_score: int = 70
    drop_min_euros: int = 20
    drop_min_percent: float = 2.0

    def __post_init__(self):
        if not self.places and not self.postcode_prefixes:
            raise ValueError("criteria need places or postcode prefixes")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_area(place: Column, postcode: Column, criteria: Criteria) -> Column:
    """Whether a listing with a place or a postcode lies where it should.

    With a list of places: the place is on it, and the postcode fits or says nothing. Without: the postcode fits.
    Without a place: no prefixes are asked for, or the postcode fits.
    """
    digits = F.regexp_replace(F.coalesce(postcode, F.lit("")), "\\D", "")
    fits = _any([digits.startswith(p) for p in criteria.postcode_prefixes])
    if criteria.places:
        keys = [k.lower() for k in criteria.places]
        named = place_key(place).isin(keys) & ((digits == "") | fits if criteria.postcode_prefixes else F.lit(True))
    else:
        named = fits
    return F.when(place.isNotNull(), _sure(named)).otherwise(fits if criteria.postcode_prefixes else F.lit(True))


def excluded_by(title: Column, description: Column, criteria: Criteria) -> Column:
    """The first pattern that the folded title, or then title and description, match; null for none."""
    head = fold(F.coalesce(title, F.lit("")))
    body = fold(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    found = [F.when(head.rlike(p), F.lit(p)) for p in criteria.exclude_title_patterns] + [F.when(body.rlike(p), F.lit(p)) for p in criteria.exclude_patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def below(value: Column, least) -> Column:
    return _sure(value < F.lit(least)) if least is not None else F.lit(False)


def above(value: Column, most) -> Column:
    return _sure(value > F.lit(most)) if most is not None else F.lit(False)


def disqualifier(place, postcode, title, description, rooms, surface, rent, criteria: Criteria) -> Column:
    """The first reason against a listing, or null."""
    pattern = excluded_by(title, description, criteria)
    return (
        F.when(place.isNull() & postcode.isNull(), F.lit("no_location"))
        .when(~in_area(place, postcode, criteria), F.lit("outside_area"))
        .when(pattern.isNotNull(), F.concat(F.lit("excluded_kind: "), pattern))
        .when(below(rooms, criteria.min_rooms), F.lit("rooms_below_min"))
        .when(below(surface, criteria.min_surface_m2), F.lit("surface_below_min"))
        .when(above(rent, criteria.max_rent), F.lit("rent_above_max"))
    )


def outcome(tenure_outcome: Column, reason: Column) -> Column:
    """A rejected tenure first, then the disqualifiers, then what the text left undecided."""
    return F.when(tenure_outcome == "REJECT", F.lit("REJECT")).when(reason.isNotNull(), F.lit("REJECT")).when(tenure_outcome == "DIGEST", F.lit("DIGEST")).otherwise(F.lit("MATCH"))


def notable_drop(previous: Column, now: Column, criteria: Criteria) -> Column:
    """A fall by enough euros or, where the former amount is positive, enough percent."""
    fall = previous - now
    share = F.when(previous > 0, fall * 100.0 / previous)
    return _sure((fall > 0) & ((fall >= criteria.drop_min_euros) | _sure(share >= criteria.drop_min_percent)))


def crossed_ceiling(previous: Column, now: Column, most: int | None) -> Column:
    return _sure((previous > most) & (now <= most)) if most is not None else F.lit(False)


def is_fresh(age_seconds: Column, minutes: int) -> Column:
    return age_seconds.isNull() | (age_seconds <= minutes * 60)
