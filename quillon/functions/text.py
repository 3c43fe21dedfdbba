"""Text as Columns: folding, token positions, keys, addresses of pages, time stamps."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented letters and their plain forms, letters that become two, apostrophes.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"
DOUBLES = [("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("Œ", "OE"), ("Æ", "AE")]
APOSTROPHES = "’‘ʼ＇`´"
# Code points that are invisible (default-ignorable ranges, controls, the braille blank).
INVISIBLE = (
    "\\p{Mn}\\p{Cf}\\x{00AD}\\x{034F}\\x{061C}\\x{115F}-\\x{1160}\\x{17B4}-\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}"
    "\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{FFF0}-\\x{FFF8}\\x{1BCA0}-\\x{1BCA3}\\x{1D173}-\\x{1D17A}\\x{E0000}-\\x{E0FFF}"
    "\\x{0000}-\\x{0008}\\x{000E}-\\x{001F}\\x{007F}-\\x{009F}\\x{2800}"
)
INVISIBLE_ASCII = "".join(map(chr, [*range(0x09), *range(0x0E, 0x20), 0x7F]))
ENTITY = "&(?:[a-zA-Z][a-zA-Z0-9]{1,10}|#\\d{1,6}|#[xX][0-9a-fA-F]{1,6});"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIMMED = " \t\n\r\0\x0b"
# Words that have no other form.
INVARIANT = ["lli", "plai", "plus", "pls", "anru", "anah", "hlm", "sne", "apl"]
# Two digits of a postcode and the département's name.
DEPARTMENTS = {"75": "Paris", "77": "Seine-et-Marne", "78": "Yvelines", "91": "Essonne", "92": "Hauts-de-Seine", "93": "Seine-Saint-Denis", "94": "Val-de-Marne", "95": "Val-d'Oise"}


def let(value: Column, f) -> Column:
    """f(value), with value computed once and its expression written once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(c, UPPER, LOWER)


def fold_keep_case(c: Column) -> Column:
    """Accents, apostrophes, invisible characters and runs of white space folded; null where the text is not valid
    UTF-8 or holds an HTML entity that was not decoded."""
    s = F.translate(c, ACCENTED + APOSTROPHES, PLAIN + "'" * len(APOSTROPHES))
    for one, two in DOUBLES:
        s = F.replace(s, F.lit(one), F.lit(two))
    s = F.regexp_replace(s, f"(?=[^ -~\\n])[{INVISIBLE}]", "")  # most characters fail the first class, which is cheap
    s = F.regexp_replace(s, "(?U)[^\\S\\n]+", " ")
    s = F.regexp_replace(s, "(?U) ?\\n\\s*", "\n")
    ascii_alone = F.octet_length(c) == F.char_length(c)  # most texts, and the same rules are much less work
    plain = F.translate(c, "`" + INVISIBLE_ASCII, "'")
    blank = "[ \\t\\x0B\\f\\r]"
    plain = F.regexp_replace(plain, f"(?:[\\t\\x0B\\f\\r]| (?={blank})){blank}*", " ")
    plain = F.regexp_replace(plain, " ?\\n\\s*", "\n")
    readable = F.is_valid_utf8(c) & ~(c.contains("&") & c.rlike(ENTITY))
    return F.when(readable, F.btrim(F.when(ascii_alone, plain).otherwise(s), F.lit(TRIMMED)))


def fold(c: Column) -> Column:
    """:func:`fold_keep_case` with A-Z in lower case."""
    return ascii_lower(fold_keep_case(c))


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """HTML entities decoded until nothing changes, three times at most."""

    def one(x):
        for _ in range(3):
            y = html.unescape(x) if x is not None and "&" in x else x
            if y == x:
                return x
            x = y
        return x

    return s.map(one, na_action="ignore")


def fold_tolerant(c: Column) -> Column:
    """Entities decoded, then folded; null where the text still can't be read."""
    return fold(decode_entities(c))


def token_pattern(needle: str) -> str:
    return f"(?<![a-z0-9]){re.escape(needle)}(?![a-z0-9])"


def token_position(folded: Column, needle: str) -> Column:
    """Place (from 0, in code points) of the first whole-token occurrence, or null."""
    if not needle:
        return F.lit(None).cast("int")
    return F.nullif(F.regexp_instr(folded, F.lit(token_pattern(needle))), F.lit(0)) - 1


def inflected_pattern(needle: str) -> str:
    """A pattern of the words of needle in their plural and feminine forms; white space between them may be missing."""
    parts = []
    for word in needle.split(" "):
        if word in INVARIANT:
            parts.append(re.escape(word))
        elif word.endswith("al"):
            parts.append(f"(?:{re.escape(word)}(?:es|e)?|{re.escape(word[:-2])}aux)")
        else:
            parts.append(f"{re.escape(word)}(?:es|e|s|x)?")
    return "(?<![a-z0-9])" + "\\s*".join(parts) + "(?![a-z0-9])"


def inflected_position(folded: Column, needle: str) -> Column:
    return F.nullif(F.regexp_instr(folded, F.lit(inflected_pattern(needle))), F.lit(0)) - 1


def inflected_match(folded: Column, needle: str) -> Column:
    return F.nullif(F.regexp_extract(folded, inflected_pattern(needle), 0), F.lit(""))


def squeeze_space(c: Column) -> Column:
    """Runs of any white space to one space, trimmed."""
    return F.btrim(F.regexp_replace(c, "(?U)\\s+", " "))


def field_key(name: Column) -> Column:
    """A field's name without particles, and with letters and digits alone."""
    s = fold(name)
    for particle in (" de ", " d'", " du ", " des "):
        s = F.replace(s, F.lit(particle), F.lit(" "))
    return F.regexp_replace(s, "[^a-z0-9]", "")


def place_key(name: Column) -> Column:
    """A place's name for comparison: folded, other characters to single spaces."""
    return F.btrim(F.regexp_replace(fold(name), "[^a-z0-9]+", " "))


def department(postcode: Column) -> Column:
    """The département of a postcode of five digits, or null."""
    digits = F.regexp_replace(postcode, "\\D", "")
    names = F.create_map(*[F.lit(x) for pair in DEPARTMENTS.items() for x in pair])
    return F.when(F.length(digits) == 5, F.try_element_at(names, F.substring(digits, 1, 2)))


def absolute_url(url: Column, base: str | None) -> Column:
    """A page's address: as it is with a scheme, else below base."""
    if not base:
        return url
    joined = F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(url, F.lit("/")))
    return F.when(url.rlike("(?i)^[a-z][a-z0-9+.\\-]*://"), url).otherwise(joined)


URL = "^([^:/?#]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?"


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, the rest as it is, without a fragment; folded text where there is no host."""
    bare = F.regexp_replace(url, "(?U)^\\s+|\\s+$", "")
    authority = F.regexp_extract(bare, URL, 2)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    host = F.regexp_extract(authority, "^(?:.*@)?([^:]*)", 1)
    port = F.regexp_extract(authority, "(:\\d+)$", 1)
    built = F.concat(
        ascii_lower(F.regexp_extract(bare, URL, 1)), F.lit("://"), user, ascii_lower(host), port, F.regexp_extract(bare, URL, 3), F.coalesce(F.regexp_extract(bare, URL, 4), F.lit(""))
    )
    return F.when(F.length(host) > 0, built).otherwise(fold(bare))


def percent_encode(c: Column) -> Column:
    """All but letters, digits and -_.~ as %XX."""
    encoded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def dedup_key(source: Column, external_id: Column, url: Column, title: Column) -> Column:
    """What a listing is known by: its source and own id, else a hash of address and title; null without any."""
    trimmed = F.btrim(F.coalesce(external_id, F.lit("")))
    address, name = F.coalesce(normal_url(url), F.lit("")), F.coalesce(fold(title), F.lit(""))
    hashed = F.concat(percent_encode(source), F.lit(":h:"), F.sha2(F.concat(address, F.lit("\n"), name), 256))
    return F.when(trimmed != "", F.concat(percent_encode(source), F.lit(":id:"), percent_encode(trimmed))).when((address != "") | (name != ""), hashed)


ISO = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?(?:Z|[+-]\\d{2}:\\d{2})$"


def iso_epoch(c: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time with an offset; null where it has none or is no date of the calendar."""
    s = F.regexp_replace(c, "(?:Z|-00:00)$", "+00:00")
    s = F.regexp_replace(s, "\\.(\\d{1,6})\\d*", ".$1")
    return F.when(c.rlike(ISO), F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(s, "\\.\\d+", ""), F.lit("yyyy-MM-dd'T'HH:mm:ssxxx"))))


def stable_link(url: Column) -> Column:
    """Scheme, host and path of a link: what names its page."""
    scheme = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("https"))
    return F.concat(scheme, F.lit("://"), F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


# Parts of links that lead to no listing.
LINK_NOISE = ["unsubscribe", "desabonnement", "desinscription", "preferences", "mailto:", "/pixel", "utm_medium=beacon"]


def is_listing_link(url: Column, host: str | None = None) -> Column:
    low = F.lower(url)
    ok = ~low.rlike("|".join(map(re.escape, LINK_NOISE)))
    return ok & low.contains(host.lower()) if host else ok
