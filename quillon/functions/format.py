"""Short texts for notifications: headline, facts, sizes, price drops, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euros(c: Column) -> Column:
    """A whole amount with spaces between thousands."""
    return F.concat(F.replace(F.format_number(c, 0), F.lit(","), F.lit(" ")), F.lit(" €"))


def square_metres(c: Column) -> Column:
    """A surface with a decimal comma, without a zero after it."""
    shown = F.replace(F.format_string("%.1f", c.cast("double")), F.lit("."), F.lit(","))
    return F.when(c.isNotNull(), F.concat(F.regexp_replace(shown, ",0$", ""), F.lit(" m²")))


def facts_line(rooms: Column, surface: Column, rent: Column) -> Column:
    """What is known of a listing, parted by dots."""
    known = F.filter(F.array(F.when(rooms.isNotNull(), F.concat(rooms.cast("string"), F.lit(" rooms"))), square_metres(surface), F.when(rent.isNotNull(), euros(rent))), lambda x: x.isNotNull())
    return F.array_join(known, " · ")


def headline(title: Column, place: Column, rooms: Column, surface: Column, rent: Column) -> Column:
    name = F.coalesce(F.nullif(F.btrim(title), F.lit("")), place, F.lit("listing"))
    facts = facts_line(rooms, surface, rent)
    return F.when(facts == "", name).otherwise(F.concat(name, F.lit(" — "), facts))


def drop_text(before: Column, now: Column) -> Column:
    """Both amounts, the difference and its share in percent."""
    share = F.when(before > 0, F.round((before - now) * 100.0 / before, 1))
    shown = F.regexp_replace(F.replace(F.format_string("%.1f", share), F.lit("."), F.lit(",")), ",0$", "")
    return F.concat(euros(before), F.lit(" → "), euros(now), F.lit(" (−"), euros(before - now), F.coalesce(F.concat(F.lit(", −"), shown, F.lit(" %")), F.lit("")), F.lit(")"))


def digest_text(lines: Column) -> Column:
    """A digest's lines (an array), sorted, each with a dash."""
    return F.array_join(F.transform(F.array_sort(lines), lambda x: F.concat(F.lit("- "), x)), "\n")


def health_text(source: Column, status: Column, last_count: Column) -> Column:
    return F.concat(source, F.lit(": "), F.lower(status), F.lit(" ("), F.coalesce(last_count.cast("string"), F.lit("no")), F.lit(" items in the last run)"))
