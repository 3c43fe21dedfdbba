"""Folding, tokens, keys, extraction, pages and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import extract as X
from quillon.functions import text as S
from quillon.functions.format import drop_text
from quillon.functions.redact import redact, redact_sql
from quillon.plans.tables import dealt, spread, table, texts
from quillon.sources import listings as L


def q_fold_text(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(S.fold(F.col("text"))).alias("folded"))


def q_token_hits(spark, sf):
    t = S.fold(F.col("text"))
    return texts(spark, sf, "documents").withColumn("t", t).select("doc_id", *[S.token_position(F.col("t"), w).isNotNull().alias(f"has_{w}") for w in ("the", "der", "les", "idiot")])


def q_inflected_hits(spark, sf):
    t = F.translate(F.col("p_name"), "_#-", "   ")
    return table(spark, sf, "part").withColumn("t", S.fold(t)).select("p_partkey", *[S.inflected_position(F.col("t"), w).isNotNull().alias(f"has_{i}") for i, w in enumerate(("steel bolt", "small", "metal"))])


def q_token_places(spark, sf):
    """Where words stand: the place of their first whole occurrence, as it is and in its inflected forms."""
    t = S.fold(F.col("text"))
    found = texts(spark, sf, "documents").withColumn("t", t)
    plain = [S.token_position(F.col("t"), w).alias(f"at_{w}") for w in ("the", "der", "les")]
    part = [S.inflected_position(F.col("t"), w).alias(f"form_{i}") for i, w in enumerate(("und", "general de"))]
    return found.select("doc_id", *plain, *part)


def q_entities_spaces(spark, sf):
    """Entities that were encoded up to three times, and white space of every kind."""
    made = F.concat(F.lit("&lt;b&gt; &amp;eacute; &amp;amp;#8364; &amp;amp;amp;eacute; "), F.col("p_name"), F.lit(" &nosuch; R&D"))
    spaces = F.concat(F.lit("\u2003\u00a0 "), F.replace("p_name", F.lit(" "), F.lit("\t\u00a0\n\u2028")), F.lit("\x85"))
    return spread(table(spark, sf, "part")).select("p_partkey", S.decode_entities(made).alias("decoded"), S.squeeze_space(spaces).alias("squeezed"))


def q_links(spark, sf):
    """Which links lead to listings of a host, and what names their page."""
    k = F.col("page_id")
    tails = F.element_at(F.array(*[F.lit(x) for x in ("?utm_medium=beacon", "/Unsubscribe", "?a=1#b", "/pixel.gif", "")]), (k % 5 + 1).cast("int"))
    url = F.when(k % 7 == 0, F.lit("mailto:me@example.org")).otherwise(F.concat(F.lit("https://Shop.example.org:444/l/"), k.cast("string"), tails))
    return texts(spark, sf, "pages").select("page_id", S.is_listing_link(url).alias("listing"), S.is_listing_link(url, "example.org:444").alias("of_host"), S.stable_link(url).alias("name"))


def q_headlines(spark, sf):
    """Headlines, digests and health lines as they are sent."""
    from quillon.functions.format import digest_text, headline, health_text

    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    title = F.when(k % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    place = F.when(k % 2 == 0, F.lit("Lyon"))
    rooms, surface, rent = F.when(k % 5 != 0, (k % 6).cast("int")), F.when(k % 4 == 0, (k % 90) + 0.5), F.when(k % 7 == 0, (k % 5000).cast("int"))
    lines = F.array(F.col("o_orderpriority"), F.lit("b"), F.concat(F.lit("a"), k.cast("string")))
    return o.select("o_orderkey", headline(title, place, rooms, surface, rent).alias("headline"), digest_text(lines).alias("digest"), health_text(F.lit("s"), F.upper("o_orderstatus"), F.when(k % 3 != 0, k % 50)).alias("health"))


def q_place_key(spark, sf):
    made = F.concat(F.lit("  Saint-"), F.col("n_name"), F.lit(" / l'Île "))
    return table(spark, sf, "nation").select("n_nationkey", S.place_key(made).alias("place_key"), S.field_key(F.concat(F.lit("Type de "), F.col("n_name"))).alias("field_key"))


def q_department(spark, sf):
    c = table(spark, sf, "customer")
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("75", "77", "78", "13")]), (F.col("c_custkey") % 4 + 1).cast("int")), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    return c.select("c_custkey", S.department(F.when(F.col("c_custkey") % 5 == 0, F.substring(code, 1, 4)).otherwise(code)).alias("department"))


def q_json_path(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), X.scalar(X.path_value(v, "k")).alias("text"), X.path_value(v, "a.b").isNull().alias("absent"))


def q_first_of(spark, sf):
    e = table(spark, sf, "events")
    made = F.when(F.col("event_id") % 3 == 0, F.lit(" N/C ")).when(F.col("event_id") % 3 == 1, F.lit("-")).otherwise(F.col("event_type"))
    return e.select("event_id", X.first_of(made, F.nullif(F.col("event_type"), F.lit("click")), F.lit("none")).alias("value"), X.is_nullish(made).alias("nullish"))


def q_number_parse(spark, sf):
    o = table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    euro, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.when(euro >= 1000, F.concat(F.floor(euro / 1000).cast("string"), F.lit(" "), F.lpad((euro % 1000).cast("string"), 3, "0"))).otherwise(euro.cast("string"))
    dotted = F.when(euro >= 1000, F.concat(F.floor(euro / 1000).cast("string"), F.lit("."), F.lpad((euro % 1000).cast("string"), 3, "0"))).otherwise(euro.cast("string"))
    return o.select("o_orderkey", X.number(F.concat(thousands, F.lit(","), rest, F.lit(" €"))).alias("comma"), X.whole(F.concat(F.lit("env. "), dotted)).alias("thousands"), X.number(F.lit("non communiqué")).alias("none"))


def q_flag_floor(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    words = F.element_at(F.array(*[F.lit(x) for x in ("Oui", "NON", "peut-être", "1", " avec ", "aucun")]), (F.col("event_id") % 6 + 1).cast("int"))
    floors = F.element_at(F.array(*[F.lit(x) for x in ("RDC", "3ème étage", "-1", "2.5", "Rez-de-chaussée", "grenier")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", X.flag(words).alias("flag"), X.floor_level(floors).alias("floor"))


def q_sniffers(spark, sf):
    o = table(spark, sf, "orders")
    body = F.concat(F.lit("Loyer : "), (F.col("o_orderkey") % 3000).cast("string"), F.lit(" € CC, T"), (F.col("o_orderkey") % 9).cast("string"), F.lit(" de "), (F.col("o_orderkey") % 140).cast("string"), F.lit(",5 m² à 75011 PARIS"))
    return o.select("o_orderkey", X.sniff_rent(body).alias("rent"), X.sniff_rooms(body).alias("rooms"), X.sniff_surface(body).alias("surface"), X.sniff_postcode(body).alias("postcode"), X.sniff_place(body, {"paris": "Paris"}).alias("place"))


def q_url_normalise(spark, sf):
    made = F.concat(F.lit(" HTTPS://WWW.Example.ORG:8080"), F.regexp_extract("url", "^[a-z]+://[^/]*(/.*)?$", 1), F.lit("#part"))
    return texts(spark, sf, "pages").select("page_id", S.normal_url(made).alias("url"), S.absolute_url(F.concat(F.lit("/p/"), F.col("page_id").cast("string")), "https://example.org/").alias("absolute"))


def q_dedup_key(spark, sf):
    ext = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("id "), F.col("page_id").cast("string")))
    return texts(spark, sf, "pages").select("page_id", S.dedup_key(F.lit("site a~b"), ext, F.col("url"), F.lit("T")).alias("key"))


def q_iso_epoch(spark, sf):
    made = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.lit("T10:20:30.5"), F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+02:00").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", S.iso_epoch(made).alias("epoch"), S.iso_epoch(F.lit("2024-02-30T00:00:00Z")).alias("never"))


def q_html_title(spark, sf):
    return L.html_cards(texts(spark, sf, "pages"), "head", {"title": "title"}).select("page_id", F.try_element_at("item", F.lit("title")).alias("title"))


def q_html_links(spark, sf):
    links = L.html_cards(texts(spark, sf, "pages"), "a", {})
    return links.groupBy("page_id").agg(F.count(F.try_element_at("item", F.lit("attr.href"))).alias("links"))


def q_html_cards(spark, sf):
    cards = L.html_cards(texts(spark, sf, "pages"), "nav li", {"link": "a @href", "name": "a", "letter": "a @href => /(.)"})
    at = lambda k: F.try_element_at("item", F.lit(k)).alias(k.strip("_"))
    return cards.select("page_id", "position", at("link"), at("name"), at("letter"), at("_text"), "error")


def _nested(spark, sf):
    """Payloads of every depth to fourteen: events' properties below lists and objects, with equal paths and nulls."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    e = dealt(e, "event_id", e.count())
    deep = (k % 15).cast("int")
    inner = F.concat(F.lit('{"p": '), F.col("props"), F.lit(', "t": "'), F.col("event_type"), F.lit('", "x": null, "v": '), k.cast("string"), F.lit(', "e": [], "q.r": 1, "q": {"r": 2, "s": [true, "", {"u": 0.25}]}}'))
    nested = F.concat(F.repeat(F.lit('{"n": [null, '), deep / 2), F.when(deep % 2 == 1, '{"o": ').otherwise(""), inner, F.when(deep % 2 == 1, "}").otherwise(""), F.repeat(F.lit("]}"), deep / 2))
    return e.select("event_id", F.when(k % 100 == 7, F.concat(F.lit("{"), nested)).when(k % 100 == 8, "12").otherwise(nested).alias("payload"))


def q_flatten(spark, sf):
    flat = _nested(spark, sf).select("event_id", X.flatten_json(F.col("payload")).alias("m"))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    return flat.select("event_id", F.size("m").cast("long").alias("n"), F.md5(lines).alias("digest"))


def q_map_items(spark, sf):
    e = table(spark, sf, "events")
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("city")).alias("address"), F.concat((F.col("event_id") % 2000).cast("string"), F.lit(" €")).alias("price"), F.lit("oui").alias("lift"), F.lit("3e étage").alias("floor")))
    fields = L.FieldMap(ref=["id"], commune=["city", "address.city"], rent=["rent.total", "price"], elevator=["lift"], floor=["floor"], charges_included=True, url=["id"], base_url="https://example.org")
    out = L.map_items(e.select(F.parse_json(made).alias("item")), "demo", fields)
    return out.select(F.col("external_id").cast("long").alias("event_id"), "commune", "rent_cc", "floor", "has_elevator", "url")


def _messages():
    """Texts with a secret of each kind in turn."""
    k = F.col("event_id").cast("string")
    kinds = [
        F.concat(F.lit("GET https://me:pw"), k, F.lit("@host.org/x?api_key=k"), k, F.lit("&page=2")), F.concat(F.lit("Authorization: Bearer abcdefgh"), k), F.concat(F.lit("a1 LOGIN user"), k, F.lit(" \"pass word\"")),
        F.concat(F.lit("LOGIN failed for session number "), k), F.concat(F.lit('{"accessToken": "t'), k, F.lit('", "topic":"x"}')), F.concat(F.lit("https://api.telegram.org/bot12345678:AA"), k, F.lit("/send ntfy.example.org/mine")),
        F.concat(F.lit("Mot de passe : s"), k, F.lit("; RFR : 23 456, mail a.b"), k, F.lit("@c.co.uk")), F.concat(F.lit("AUTH PLAIN dXNlcgBwYXNzd29yZA\nS: QWxhZGRpbjpvcGVuIHNlc2FtZQ"), k, F.lit("==")), F.concat(F.lit("the key is on the table: "), k),
        F.concat(F.lit("RFR_N2=4125"), k, F.lit(" trop haut; IMAP_PASSWORD2=h"), k, F.lit(", x2password=h"), k), F.concat(F.lit("CLIENT -> SERVER: bW90ZGVwYXNzZXNl\nNO "), k), F.concat(F.lit("refused: key=https://cb.org/hook?apikey=a"), k),
        F.concat(F.lit("LOGIN sur imap.org, AUTHENTICATE mechanism not supported, PASS erreur "), k), F.concat(F.lit("sum\n"), F.sha2(k, 256), F.lit("\nother")), F.concat(F.lit("AUTHENTICATE XOAUTH2 rejected, clientSecret=s"), k, F.lit(" bypass: no")),
        F.concat(F.lit("from "), F.col("event_type"), F.lit(": pass 2 of 3, PASSAGE="), k, F.lit(", unexpected token: }")), F.concat(F.lit("https://api.telegram.org:443/file/bot1:x"), k, F.lit("/f.jpg and 77"), k, F.lit(":AAbbCCddEEffGGhhIIjjKKllMMnnOOpp_q")),
    ]
    return F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int"))


def q_redact(spark, sf):
    return table(spark, sf, "events").select("event_id", redact(_messages()).alias("masked"))


def q_redact_all(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(redact(F.col("text"))).alias("masked"))


def q_drop_text(spark, sf):
    o = table(spark, sf, "orders")
    before, now = (F.col("o_orderkey") % 3000 + 1000).cast("int"), (F.col("o_orderkey") % 900 + 500).cast("int")
    return o.select("o_orderkey", drop_text(before, now).alias("text"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_ACC, _PLAIN = S.ACCENTED + S.APOSTROPHES, S.PLAIN + "'" * len(S.APOSTROPHES)
_DOUBLES = "replace(replace(replace(replace(replace(translate({c}, '" + _ACC + "', '" + _PLAIN.replace("'", "''") + "'), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'Œ', 'OE'), 'Æ', 'AE')"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _fold_sql(c: str) -> str:
    bare = "regexp_replace(" + _DOUBLES.format(c=c) + ", '[\\p{Mn}\\p{Cf}\\x{0000}-\\x{0008}\\x{000E}-\\x{001F}\\x{007F}-\\x{009F}]', '', 'g')"
    return f"translate(trim(regexp_replace(regexp_replace({bare}, '[\\t\\v\\f\\r\\p{{Zs}}]+', ' ', 'g'), ' ?\\n\\s*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), {_LOW})"


def _plain_html(c: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{plain}')"
    return c


_ENTITY_SQL = "regexp_matches(text, '&(?:[a-zA-Z][a-zA-Z0-9]{1,10}|#\\d{1,6}|#[xX][0-9a-fA-F]{1,6});')"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
ORACLES = {
    "q_fold_text": f"SELECT doc_id, CASE WHEN NOT {_ENTITY_SQL} THEN md5({_fold_sql('text')}) END AS folded FROM documents",
    "q_token_hits": "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(t, '(^|[^a-z0-9]){w}([^a-z0-9]|$)'), false) AS has_{w}" for w in ("the", "der", "les", "idiot")) + f" FROM (SELECT doc_id, CASE WHEN NOT {_ENTITY_SQL} THEN {_fold_sql('text')} END AS t FROM documents)",
    "q_inflected_hits": "SELECT p_partkey, " + ", ".join(f"regexp_matches(t, '(^|[^a-z0-9])(?:{p})([^a-z0-9]|$)') AS has_{i}" for i, p in enumerate(("steel(?:es|e|s|x)?\\s*bolt(?:es|e|s|x)?", "small(?:es|e|s|x)?", "(?:metal(?:es|e)?|metaux)"))) + " FROM (SELECT p_partkey, lower(translate(p_name, '_#-', '   ')) AS t FROM part)",
    "q_token_places": "SELECT doc_id, " + ", ".join(f"CASE WHEN regexp_matches(t, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN CAST(length(regexp_extract(t, '(?s)^(.*?[^a-z0-9])??(?:{w})(?:[^a-z0-9]|$)', 1)) AS INTEGER) END AS {n}" for n, w in (("at_the", "the"), ("at_der", "der"), ("at_les", "les"), ("form_0", "(?:und(?:es|e|s|x)?)"), ("form_1", "(?:(?:general(?:es|e)?|generaux)\\s*de(?:es|e|s|x)?)"))) + f" FROM (SELECT doc_id, CASE WHEN NOT {_ENTITY_SQL} THEN {_fold_sql('text')} END AS t FROM documents)",
    "q_entities_spaces": "SELECT p_partkey, '<b> é € &eacute; ' || p_name || ' &nosuch; R&D' AS decoded, trim(regexp_replace(p_name, ' +', ' ', 'g')) AS squeezed FROM part",
    "q_links": """SELECT page_id, page_id % 7 <> 0 AND page_id % 5 NOT IN (0, 1, 3) AS listing, page_id % 7 <> 0 AND page_id % 5 NOT IN (0, 1, 3) AS of_host,
      CASE WHEN page_id % 7 = 0 THEN 'mailto://' ELSE 'https://Shop.example.org/l/' || page_id || CASE page_id % 5 WHEN 1 THEN '/Unsubscribe' WHEN 3 THEN '/pixel.gif' ELSE '' END END AS name FROM pages""",
    "q_headlines": """WITH f AS (SELECT *, concat_ws(' · ', CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 6 || ' rooms' END, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 || ',5 m²' END,
        CASE WHEN o_orderkey % 7 = 0 THEN replace(format('{:,}', o_orderkey % 5000), ',', ' ') || ' €' END) AS facts FROM orders)
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN 'Lyon' ELSE 'listing' END || CASE WHEN facts <> '' THEN ' — ' || facts ELSE '' END AS headline,
        '- ' || array_to_string(list_sort([o_orderpriority, 'b', 'a' || o_orderkey]), chr(10) || '- ') AS digest, 's: ' || lower(o_orderstatus) || ' (' || CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 50 AS VARCHAR) ELSE 'no' END || ' items in the last run)' AS health FROM f""",
    "q_place_key": "SELECT n_nationkey, trim(regexp_replace(lower('saint-' || n_name || ' / l''ile '), '[^a-z0-9]+', ' ', 'g')) AS place_key, regexp_replace('type ' || lower(n_name), '[^a-z0-9]', '', 'g') AS field_key FROM nation",
    "q_department": "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN ['Paris', 'Seine-et-Marne', 'Yvelines', NULL][CAST(c_custkey % 4 + 1 AS INTEGER)] END AS department FROM customer",
    "q_json_path": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS text, true AS absent FROM events",
    "q_first_of": """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN event_type WHEN event_type = 'click' THEN 'none' ELSE event_type END AS value, event_id % 3 <> 2 AS nullish FROM events""",
    "q_number_parse": f"SELECT o_orderkey, {_CENTS} / 100.0 AS comma, CAST({_CENTS} // 100 AS INTEGER) AS thousands, CAST(NULL AS DOUBLE) AS none FROM orders",
    "q_flag_floor": "SELECT event_id, [true, false, NULL, true, true, false][CAST(event_id % 6 + 1 AS INTEGER)] AS flag, [0, 3, -1, 3, 0, NULL][CAST(event_id % 6 + 1 AS INTEGER)] AS floor FROM events",
    "q_sniffers": """SELECT o_orderkey, CASE WHEN o_orderkey % 3000 >= 200 THEN CAST(o_orderkey % 3000 AS INTEGER) END AS rent, CASE WHEN o_orderkey % 9 >= 1 THEN CAST(o_orderkey % 9 AS INTEGER) END AS rooms,
      CASE WHEN o_orderkey % 140 + 0.5 >= 5 THEN CAST(o_orderkey % 140 + 0.5 AS DOUBLE) END AS surface, '75011' AS postcode, 'Paris' AS place FROM orders""",
    "q_url_normalise": "SELECT page_id, 'https://www.example.org:8080' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/.*)?$', 1), '#.*', '') AS url, 'https://example.org/p/' || page_id AS absolute FROM pages",
    "q_dedup_key": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'site%20a~b:id:id%20' || page_id ELSE 'site%20a~b:h:' || sha256(regexp_replace(url, '#.*', '') || chr(10) || 't') END AS key FROM pages",
    "q_iso_epoch": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 37230 - CASE WHEN o_orderkey % 3 = 1 THEN 7200 ELSE 0 END END AS epoch, CAST(NULL AS BIGINT) AS never FROM orders",
    "q_html_title": f"""SELECT page_id, nullif(trim(regexp_replace({_plain_html("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')), '') AS title FROM pages""",
    "q_html_cards": f"""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>(.*?)</li>', 1) AS lis FROM pages),
      c AS (SELECT page_id, unnest(lis) AS li, unnest(range(len(lis))) AS position FROM n)
      SELECT page_id, CAST(position AS INTEGER) AS position, {_plain_html("regexp_extract(li, 'href=\"([^\"]*)\"', 1)")} AS link, {_plain_html("regexp_extract(li, '>([^<]*)<', 1)")} AS name,
        left({_plain_html("regexp_extract(li, 'href=\"/([^\"]*)\"', 1)")}, 1) AS letter, {_plain_html("regexp_extract(li, '>([^<]*)<', 1)")} AS text, CAST(NULL AS VARCHAR) AS error FROM c
      UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, 'no card found' FROM n WHERE len(lis) = 0""",
    "q_html_links": "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links FROM pages",
    # of equal paths the one below an object comes first (q before q.r); 13 names lead to a leaf at most
    "q_flatten": """WITH d AS (SELECT event_id, event_id % 15 AS d, '{"p": ' || props || ', "t": "' || event_type || '", "x": null, "v": ' || event_id || ', "e": [], "q.r": 1, "q": {"r": 2, "s": [true, "", {"u": 0.25}]}}' AS inner_text FROM events),
      p AS (SELECT event_id, CASE WHEN event_id % 100 = 7 THEN NULL WHEN event_id % 100 = 8 THEN '12'
        ELSE repeat('{"n": [null, ', d // 2) || CASE WHEN d % 2 = 1 THEN '{"o": ' ELSE '' END || inner_text || CASE WHEN d % 2 = 1 THEN '}' ELSE '' END || repeat(']}', d // 2) END AS j FROM d),
      leaves AS (SELECT event_id, replace(replace(replace(substr(t.fullkey, 3), '[', '.'), ']', ''), '"', '') AS path, json_extract_string(t.value, '$') AS text, t.fullkey LIKE '%"q.r"%' AS second,
          len(regexp_extract_all(replace(t.fullkey, '"q.r"', 'qr'), '[.\\[]')) AS names FROM p, json_tree(CAST(p.j AS JSON)) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
      kept AS (SELECT event_id, path, arg_min(text, second) AS text FROM leaves WHERE names BETWEEN 1 AND 13 GROUP BY ALL)
      SELECT event_id, CASE WHEN j IS NOT NULL THEN count(path) END AS n, CASE WHEN j IS NOT NULL THEN md5(coalesce(string_agg(path || '=' || text, chr(10) ORDER BY path || '=' || text), '')) END AS digest
      FROM p LEFT JOIN kept USING (event_id) GROUP BY event_id, j""",
    "q_map_items": "SELECT event_id, event_type AS commune, CAST(event_id % 2000 AS INTEGER) AS rent_cc, 3 AS floor, true AS has_elevator, 'https://example.org/' || event_id AS url FROM events",
    "q_redact": """SELECT event_id, [
      'GET https://[masked]@host.org/x?api_key=[masked]&page=2', 'Authorization: [masked]', 'a1 LOGIN [masked]', 'LOGIN failed for session number ' || event_id, '{"accessToken": [masked], "topic":[masked]}',
      'https://api.telegram.org/bot[masked]/send ntfy.example.org/[masked]', 'Mot de passe : [masked]; RFR : [masked], mail [masked]', 'AUTH PLAIN [masked]' || chr(10) || 'S: [masked]', 'the key is on the table: ' || event_id,
      'RFR_N2=[masked] trop haut; IMAP_PASSWORD2=[masked], x2password=[masked]', 'CLIENT -> SERVER: [masked]' || chr(10) || 'NO ' || event_id, 'refused: key=https://cb.org/hook?apikey=[masked]',
      'LOGIN sur imap.org, AUTHENTICATE mechanism not supported, PASS erreur ' || event_id, 'sum' || chr(10) || sha256(CAST(event_id AS VARCHAR)) || chr(10) || 'other', 'AUTHENTICATE XOAUTH2 rejected, clientSecret=[masked] bypass: no',
      'from ' || event_type || ': pass 2 of 3, PASSAGE=' || event_id || ', unexpected token: }', 'https://api.telegram.org:443/file/bot[masked]/f.jpg and ' || CASE WHEN event_id >= 100 THEN '[masked]' ELSE '77' || event_id || ':AAbbCCddEEffGGhhIIjjKKllMMnnOOpp_q' END
      ][CAST(event_id % 17 + 1 AS INTEGER)] AS masked FROM events""",
    "q_redact_all": f"SELECT doc_id, md5({redact_sql('text')}) AS masked FROM documents",
    "q_drop_text": """SELECT o_orderkey, replace(format('{:,}', b), ',', ' ') || ' € → ' || replace(format('{:,}', n), ',', ' ') || ' € (−' || replace(format('{:,}', b - n), ',', ' ') || ' €, −'
      || regexp_replace(replace(printf('%.1f', round((b - n) * 100.0 / b, 1)), '.', ','), ',0$', '') || ' %)' AS text FROM (SELECT o_orderkey, o_orderkey % 3000 + 1000 AS b, o_orderkey % 900 + 500 AS n FROM orders)""",
}
