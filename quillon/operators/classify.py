"""Tenure of a listing from its text and fields: signals on five tiers, doubts, a winner, confidence and routing.

All rules are data, compiled into Columns over arrays of surfaces (the text, identifying columns, field names and
values), so a listing is classified where it is and nothing is shuffled. Positions are counted in code points.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import ascii_lower, field_key, fold, fold_keep_case, inflected_pattern, let
from quillon.schema import ELIGIBLE, EXCLUDED, listing_text

# Confidence by tier, what other tiers add or take, limits, the least that a mixed source needs.
TIER_BASE = {1: 97, 2: 90, 3: 80, 4: 70, 5: 50}
AGREES, OBJECTS, MOST, LEAST, FLOOR = 3, 15, 99, 10, 60

# Keys of fields that name a financing; labels and procedures with the tenure that they speak for.
TENURE_FIELDS = [
    "tenurefield", "financement", "typefinancement", "financementlogement", "typeproduit", "produit", "categorie", "category",
    "categorielogement", "typelogement", "dispositif", "regime", "conventionnement", "agrement",
]
LABELS = [
    ("logement locatif intermediaire", "LLI"), ("logement intermediaire", "LLI"), ("loyer intermediaire", "LLI"), ("lli", "LLI"), ("loyer libre", "LIBRE"),
    ("pret locatif intermediaire", "LLI"), ("conventionne anah", "ANAH"), ("loc'avantages", "ANAH"), ("loc avantages", "ANAH"), ("locavantages", "ANAH"),
    ("louer abordable", "ANAH"), ("convention anah", "ANAH"), ("conventionne anru", "ANRU"), ("pret locatif a usage social", "PLUS"),
    ("pret locatif aide d'integration", "PLAI"), ("pret locatif social", "PLS"), ("logement locatif social", "SOCIAL"), ("logement social", "SOCIAL"),
    ("habitation a loyer modere", "SOCIAL"), ("hlm", "SOCIAL"), ("plai", "PLAI"), ("pls", "PLS"), ("anru", "ANRU"), ("anah", "ANAH"), ("conventionne", "CONVENTIONNE"),
]
PROCEDURES = [
    ("sans condition de commission", "LLI"), ("sans commission d'attribution", "LLI"), ("attribution directe", "LLI"), ("numero unique d'enregistrement", "SOCIAL"),
    ("numero unique", "UNKNOWN"), ("loyer maitrise", "UNKNOWN"), ("loyer abordable", "UNKNOWN"), ("systeme national d'enregistrement", "SOCIAL"), ("sne", "SOCIAL"),
    ("demande de logement social", "SOCIAL"), ("commission d'attribution", "SOCIAL"), ("commission attribution", "SOCIAL"),
]
NEGATED_BY_SANS = ["commission d'attribution", "commission attribution"]
ACRONYMS = "PLAI|PLUS|PLS|LLI"
# Words before PLUS that make it the name of a financing.
COLLOCATION_WORDS = [
    "logement", "logements", "financement", "financements", "categorie", "categories", "type", "types", "typologie", "produit", "produits", "agrement", "dispositif", "programme", "regime", "conventionnement",
]
# Words after PLUS that make it a comparative.
COMPARATIVE_WORDS = [
    "de", "des", "du", "d'", "que", "qu'", "grand", "grande", "grands", "grandes", "petit", "petite", "spacieux", "spacieuse", "lumineux", "lumineuse", "recent", "recente", "calme", "proche", "proches", "cher", "chere",
    "tard", "tot", "haut", "haute", "bas", "basse", "pres", "loin", "rapide", "facile", "eleve", "elevee", "beau", "belle", "joli", "jolie", "vaste", "clair", "claire", "grand-e", "important", "importante",
]
COLLOCATION, COMPARATIVE = "|".join(COLLOCATION_WORDS), "|".join(COMPARATIVE_WORDS)

# Folded text has spaces and line feeds alone as white space.
_SEP = "[ /\\-,:;()]{1,3}"
_OR = f"(?:(?i:ou|et){_SEP})?"
_END = "(?![A-Za-z0-9])"
_PLUS = f"(?<![A-Za-z0-9])PLUS{_END}"
_COMPARES = f"[ ]*(?i:{COMPARATIVE}){_END}"
_CONTEXTS = [
    f"(?<=(?:^|[^A-Za-z0-9])(?i:{COLLOCATION}){_SEP}){_PLUS}",
    f"{_PLUS}(?={_SEP}{_OR}(?:{ACRONYMS}){_END})",
    f"(?<=(?:^|[^A-Za-z0-9])(?:{ACRONYMS}){_SEP}{_OR}){_PLUS}",
]
_CONFIDENT = f"(?=[ ]*(?:\\n|\\z)|[ ]*[,;:.!?)\\]/\\-–—]|[ ]*(?:(?i:ou|et)[ ]+)?(?:{ACRONYMS}){_END})"
PLUS_SURE = "|".join(f"(?:{c}{_CONFIDENT})" for c in _CONTEXTS)
PLUS_UNSURE = "|".join(f"(?:{c}(?!{_COMPARES}))" for c in _CONTEXTS)
PLUS_ALONE = f"{_PLUS}(?!{_COMPARES})"
PLUS_ALONE_ANY = PLUS_ALONE.replace("PLUS", "(?i:PLUS)")
PLUS_ANY = f"(?<![A-Za-z0-9])(?i:PLUS){_END}"
_SEPS = "[\\s/\\-,;:()+&.]"
CODE_LIST = f"^{_SEPS}*(?:(?:(?i:{ACRONYMS})|[A-Z]{{1,3}}|[0-9]+)(?:{_SEPS}+|$))+$"
CODE_ACRONYM = f"(?:^|{_SEPS})(?i:{ACRONYMS})(?:{_SEPS}|$)"

SIGNAL = "struct<tier:int,tenure:string,reason:string,evidence:string,position:int,length:int>"
NO_SIGNALS = f"array<{SIGNAL}>"


def _squashed(literal: str) -> str:
    return re.sub("[^a-z0-9]", "", literal)


def _stem(words: str) -> str:
    """The longest part that every form of the words holds: patterns run only where it occurs."""
    return max((w[:-2] if w.endswith("al") else w for w in words.split(" ")), key=len)


def _at(text: Column, words: str) -> Column:
    """Place (from 0) of the first form of the words, or null."""
    return F.when(text.contains(_stem(words)), F.nullif(F.regexp_instr(text, F.lit(inflected_pattern(words))), F.lit(0)) - 1)


_EXCLUDED_LABELS = [(w, t) for w, t in LABELS if t not in ELIGIBLE]
_EXCLUDED_PROCEDURES = [(w, t) for w, t in PROCEDURES if t not in ELIGIBLE]
#: Several words without spaces, the longest first: as identifiers hold them.
_KEYS = sorted({_squashed(w): w for w, _ in _EXCLUDED_LABELS + _EXCLUDED_PROCEDURES if " " in w and len(_squashed(w)) >= 8}.items(), key=lambda x: -len(x[0]))
_ANY_KEY = "|".join(k for k, _ in _KEYS)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decoded(values: pa.Array) -> pa.Array:
    """Entities decoded until nothing changes, three times at most; batches without any value are passed on as they are."""
    found = values.flatten()
    if not len(found):
        return values

    def one(x: str) -> str:
        for _ in range(3):
            if (y := html.unescape(x)) == x:
                break
            x = y
        return x

    out = pa.array([one(x) for x in found.to_pylist()], found.type)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))]), pa.int32()), out)


def signal(tier, tenure, reason: Column, evidence: Column, position=None, length=None) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(
        lit(tier, "int").alias("tier"), lit(tenure, "string").alias("tenure"), reason.alias("reason"), evidence.alias("evidence"),
        F.coalesce(lit(position, "int"), F.lit(0)).alias("position"), F.coalesce(lit(length, "int"), F.octet_length(evidence)).alias("length"),
    )


def _none() -> Column:
    return F.array().cast(NO_SIGNALS)


def label_hits(folded: Column) -> Column:
    """The first occurrence of each label: struct(position, literal, tenure, matched); of those at one place the longest."""

    def one(w: str, t: str) -> Column:
        matched = F.regexp_extract(folded, inflected_pattern(w), 0)
        return let(_at(folded, w), lambda at: F.when(at.isNotNull(), F.struct(at.alias("position"), F.lit(w).alias("literal"), F.lit(t).alias("tenure"), matched.alias("matched"))))

    def longest(hits: Column) -> Column:
        return F.filter(hits, lambda h: ~(h["tenure"].isin(ELIGIBLE) & h["matched"].contains("\n")) & ~F.exists(hits, lambda o: (o["position"] == h["position"]) & (F.length(o["literal"]) > F.length(h["literal"]))))

    return let(F.filter(F.array(*[one(w, t) for w, t in LABELS]), lambda h: h.isNotNull()), longest)


def _after_sans(text: Column, position: Column) -> Column:
    return F.substring(text, F.lit(1), position).rlike("\\bsans[ ]+$")


def procedure_signals(folded: Column) -> Column:
    def one(w: str, t: str) -> Column:
        def of(at: Column) -> Column:
            ok = at.isNotNull()
            if w in NEGATED_BY_SANS:
                ok = ok & ~_after_sans(folded, at)
            if t in ELIGIBLE:
                ok = ok & ~F.regexp_extract(folded, inflected_pattern(w), 0).contains("\n")
            return F.when(ok, signal(3, t, F.lit(f"procedure: {w}"), F.lit(w), at))

        return let(_at(folded, w), of)

    return F.filter(F.array(*[one(w, t) for w, t in PROCEDURES]), lambda x: x.isNotNull())


def excluded_word(cased: Column) -> Column:
    """The first excluded word in a value or identifier (cased: folded with its case), or null."""

    def of(s: Column) -> Column:
        has = lambda w: s.contains(_stem(w)) & s.rlike(inflected_pattern(w))
        found = [F.when(has(w), F.lit(w)) for w, _ in _EXCLUDED_LABELS]
        for w, _ in _EXCLUDED_PROCEDURES:
            ok = has(w)
            if w in NEGATED_BY_SANS:
                ok = ok & ~_after_sans(s, F.regexp_instr(s, F.lit(inflected_pattern(w))) - 1)
            found.append(F.when(ok, F.lit(w)))
        found.append(F.when(s.contains("plus") & s.rlike(PLUS_ANY), F.lit("PLUS")))
        return F.coalesce(*found)

    def squashed(key: Column) -> Column:
        found = [F.when(key.contains(k) & (~key.contains("sans" + k) if w in NEGATED_BY_SANS else F.lit(True)), F.lit(w)) for k, w in _KEYS]
        return F.when(key.rlike(_ANY_KEY), F.coalesce(*found))

    split = F.regexp_replace(F.regexp_replace(cased, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    both = F.transform(F.array(cased, split), lambda x: let(ascii_lower(x), of))
    key = F.regexp_replace(ascii_lower(cased), "[^a-z0-9]", "")
    # a value without a letter can't hold a word
    return F.when(cased.rlike("[A-Za-z]"), F.coalesce(F.get(F.filter(both, lambda x: x.isNotNull()), F.lit(0)), let(key, squashed)))


def _doubt(tier: int, what: Column, word: Column) -> Column:
    return signal(tier, "UNKNOWN", F.concat(F.lit("check: "), what), F.concat(word, F.lit("?")))


def field_entries(fields: Column) -> Column:
    """The fields but the page's text, each with its name and value folded."""
    entries = F.filter(F.map_entries(fields), lambda e: e["key"] != "_text")
    return F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("name"), fold_keep_case(e["key"]).alias("name_cased"), field_key(e["key"]).alias("key"), e["value"].isNotNull().alias("given"), fold_keep_case(e["value"]).alias("cased")),
    )


def field_signals(entries: Column) -> Column:
    """Signals of the fields: names and values with excluded words, and what financing fields say."""

    def financing(e: Column) -> Column:
        name, cased = e["name"], e["cased"]

        def acronym(places: Column) -> Column:
            at = lambda p: F.nullif(F.regexp_instr(cased, F.lit(p)), F.lit(0)) - 1
            listed = cased.rlike(CODE_LIST) & cased.rlike(CODE_ACRONYM)
            found = F.when(listed, F.struct(at(PLUS_ANY).alias("at"), F.lit("PLUS").alias("tenure"))).otherwise(
                F.coalesce(*[F.when(at(p).isNotNull(), F.struct(at(p).alias("at"), F.lit(t).alias("tenure"))) for p, t in ((PLUS_SURE, "PLUS"), (PLUS_UNSURE, "UNKNOWN"), (PLUS_ALONE_ANY, "UNKNOWN"))])
            )
            return F.when(
                cased.rlike("(?i)plus"),
                let(found, lambda x: F.when(x["at"].isNotNull() & ~F.array_contains(places, F.coalesce(x["at"], F.lit(-1))), F.array(signal(1, x["tenure"], F.concat(F.lit("field "), name), F.lit("PLUS"), x["at"])))),
            )

        says = lambda hits: F.concat(
            F.transform(hits, lambda h: signal(1, h["tenure"], F.concat(F.lit("field "), name), h["literal"], h["position"])), F.coalesce(acronym(F.transform(hits, lambda h: h["position"])), _none())
        )
        return let(label_hits(ascii_lower(cased)), says)

    def of(e: Column) -> Column:
        name, cased = e["name"], e["cased"]
        by_name = let(excluded_word(e["name_cased"]), lambda w: F.when(w.isNotNull(), F.array(_doubt(1, F.concat(F.lit("name of field "), name), w))).otherwise(_none()))
        unreadable = F.array(signal(1, "UNKNOWN", F.concat(F.lit("check: unreadable field "), name), F.lit("?")))
        plain = F.when(cased.isNull() & e["given"], unreadable).otherwise(
            let(excluded_word(cased), lambda w: F.when(w.isNotNull(), F.array(_doubt(1, F.concat(F.lit("field "), name), w))).otherwise(_none()))
        )
        return F.concat(by_name, F.when(e["key"].isin(TENURE_FIELDS), F.coalesce(financing(e), _none())).otherwise(plain))

    return F.coalesce(F.flatten(F.transform(entries, of)), _none())


def identity_signals(named: Column) -> Column:
    """named: array of struct(name, cased)."""
    found = F.transform(named, lambda x: let(excluded_word(x["cased"]), lambda w: F.when(w.isNotNull(), _doubt(1, x["name"], w))))
    return F.filter(found, lambda x: x.isNotNull())


def text_signals(folded: Column, cased: Column) -> Column:
    """Labels in the text, without "conventionné" right after an intermediate label, and the acronym PLUS."""

    def between(h: Column, o: Column) -> Column:
        end = o["position"] + F.length(o["matched"])
        return (o["tenure"] == "LLI") & (end <= h["position"]) & F.substring(folded, end + 1, h["position"] - end).rlike("^[ (\\[«\"']*$")

    def says(hits: Column) -> Column:
        kept = F.filter(hits, lambda h: ~((h["literal"] == "conventionne") & F.exists(hits, lambda o: between(h, o))))
        return F.transform(kept, lambda h: signal(2, h["tenure"], F.concat(F.lit("text: "), h["literal"]), h["literal"], h["position"], F.octet_length(h["matched"])))

    at = lambda p: F.nullif(F.regexp_instr(cased, F.lit(p)), F.lit(0)) - 1
    plus = F.coalesce(
        let(at(PLUS_SURE), lambda x: F.when(x.isNotNull(), F.array(signal(2, "PLUS", F.lit("text: PLUS in context"), F.lit("PLUS"), x)))),
        let(F.coalesce(at(PLUS_UNSURE), at(PLUS_ALONE)), lambda x: F.when(x.isNotNull(), F.array(signal(2, "UNKNOWN", F.lit("check: PLUS"), F.lit("PLUS?"), x)))),
        _none(),
    )
    return F.concat(let(label_hits(folded), says), F.when(cased.contains("PLUS"), plus).otherwise(_none()))


def income_band(amount: Column, bands: list[tuple[str, int, int]]) -> Column:
    """The tenure whose band (tenure, least, most) holds an income ceiling; null by default, for no bands are known."""
    found = [F.when(amount.between(lo, hi), F.lit(t)) for t, lo, hi in bands]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _agrees(a: Column, b: Column) -> Column:
    return (a == b) | ((a == "SOCIAL") & b.isin(EXCLUDED)) | ((b == "SOCIAL") & a.isin(EXCLUDED))


def classify(listings: DataFrame) -> DataFrame:
    """listings (with family, default_tenure and mixed_tenure of their source) with ``signals``, ``tenure``,
    ``confidence``, ``outcome`` (MATCH, DIGEST, REJECT) and ``tenure_reasons``.

    A text that can't be read, or holds entities that were not decoded, is UNKNOWN with confidence 0.
    """
    text = listing_text(F.col("title"), F.col("description"), F.col("fields"))
    df = listings.withColumn("__text", text).withColumn("__cased", fold_keep_case(F.col("__text"))).withColumn("__folded", ascii_lower(F.col("__cased")))
    names = ["url", "commune", "postcode", "external_id"]
    # what holds an entity goes to Python and back, in one batch with all of a row's values
    entries = F.coalesce(F.map_entries("fields"), F.array().cast("array<struct<key:string,value:string>>"))
    pending = F.filter(F.concat(F.array(*names), F.transform(entries, lambda e: e["value"])), lambda x: F.coalesce(x.contains("&"), F.lit(False)))
    df = df.withColumn("__pending", F.array_distinct(pending)).withColumn("__decoded", _decoded("__pending"))
    plain = lambda x: F.when(x.contains("&"), F.get("__decoded", F.array_position("__pending", x).cast("int") - 1)).otherwise(x)
    df = df.withColumn("__fields", F.transform_values("fields", lambda k, v: plain(v)))
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])
    df = df.withColumn("__named", F.transform(named, lambda x: F.struct(x["name"].alias("name"), fold_keep_case(plain(x["value"])).alias("cased"))))
    df = df.withColumn("__entries", F.coalesce(field_entries(F.col("__fields")), F.array().cast("array<struct<name:string,name_cased:string,key:string,given:boolean,cased:string>>")))
    page = F.try_element_at("__fields", F.lit("_text"))
    df = df.withColumn("__surfaces", F.filter(F.concat(F.array("__folded"), F.transform("__entries", lambda e: ascii_lower(e["cased"])), F.array(fold(page))), lambda x: x.isNotNull()))
    procedures = F.flatten(F.transform("__surfaces", procedure_signals))
    df = df.withColumn("__all", F.concat(identity_signals(F.col("__named")), field_signals(F.col("__entries")), text_signals(F.col("__folded"), F.col("__cased")), procedures))
    df = df.withColumn("__doubts", F.filter("__all", lambda s: s["tenure"] == "UNKNOWN")).withColumn("__own", F.filter("__all", lambda s: s["tenure"] != "UNKNOWN"))
    default = F.when(
        (F.size("__all") == 0) & F.col("default_tenure").isNotNull(), F.array(signal(5, F.col("default_tenure"), F.lit("default of the source"), F.lit("source-default")))
    ).otherwise(_none())
    df = df.withColumn("__evidence", F.concat("__own", default))
    ranked = F.array_sort(F.transform("__evidence", lambda s, i: F.struct(s["tier"].alias("tier"), s["position"].alias("position"), (-F.octet_length(s["evidence"])).alias("n"), i.alias("i"), s["tenure"].alias("tenure"))))
    df = df.withColumn("__winner", F.try_element_at(ranked, F.lit(1)))
    tier, won = F.col("__winner.tier"), F.col("__winner.tenure")
    base = F.try_element_at(F.create_map(*[F.lit(x) for p in TIER_BASE.items() for x in p]), tier)
    votes = F.aggregate(F.filter("__evidence", lambda s: s["tier"] != tier), F.lit(0), lambda a, s: a + F.when(_agrees(s["tenure"], won), AGREES).otherwise(-OBJECTS))
    confidence = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), base + votes))
    conflict = won.isin(ELIGIBLE) & (F.exists("__evidence", lambda s: s["tenure"].isin(EXCLUDED)) | (F.size("__doubts") > 0))
    weak = won.isin(ELIGIBLE) & (confidence < FLOOR) & F.col("mixed_tenure")
    unreadable = F.col("__cased").isNull()
    lost = unreadable | won.isNull() | conflict | weak
    extra = (
        F.when(unreadable, F.array(signal(0, "UNKNOWN", F.lit("unreadable text"), F.lit("malformed-text"))))
        .when(conflict, F.array(signal(tier, "UNKNOWN", F.lit("conflict"), F.lit("conflict-rule"), F.col("__winner.position"))))
        .when(weak, F.array(signal(0, "UNKNOWN", F.lit("too unsure for a mixed source"), F.lit("fail-closed"))))
        .otherwise(_none())
    )
    df = df.withColumn("signals", F.when(unreadable, extra).otherwise(F.concat("__evidence", "__doubts", extra)))
    df = df.withColumn("tenure", F.when(F.coalesce(lost, F.lit(True)), F.lit("UNKNOWN")).otherwise(won))
    df = df.withColumn("confidence", F.when(F.col("tenure") == "UNKNOWN", F.lit(0)).otherwise(confidence))
    routed = (
        F.when(F.col("tenure").isin(EXCLUDED), F.lit("REJECT"))
        .when(F.col("tenure") == "UNKNOWN", F.lit("DIGEST"))
        .when((F.col("confidence") >= FLOOR) | ~F.col("mixed_tenure"), F.lit("MATCH"))
        .otherwise(F.lit("DIGEST"))
    )
    ordered = F.array_sort(F.transform("signals", lambda s, i: F.struct(s["tier"].alias("t"), s["position"].alias("p"), i.alias("i"), s["reason"].alias("r"))))
    return df.withColumn("outcome", routed).withColumn("tenure_reasons", F.transform(ordered, lambda s: s["r"])).select(*listings.columns, "signals", "tenure", "confidence", "outcome", "tenure_reasons")
