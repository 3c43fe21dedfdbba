"""Sources: files that Spark lands from the tables, read again by what is declared of them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from quillon.operators import state
from quillon.plans.queries_text import _plain_html
from quillon.plans.tables import table, texts
from quillon.shared import shared_folder
from quillon.sources import cards, landed, robots
from quillon.sources import contract as C
from quillon.sources import listings as L
from quillon.sources.listings import FieldMap

#: When the harvest of these queries runs.
NOW = 1_700_000_000


def _land(files, folder: str) -> None:
    """Files (name, content) into a folder."""
    landed.register(files.sparkSession)
    files.write.format("landed").mode("append").option("path", folder).save()


def _customers(spark, sf):
    """Payloads of a hundred customers each: some are no objects, some have no id; one file is broken off."""
    k = F.col("c_custkey")
    price = F.concat(F.floor(F.abs("c_acctbal")).cast("string"), F.lit(" €"))
    whole = F.to_json(F.struct(k.alias("id"), F.struct(F.col("c_mktsegment").alias("city")).alias("address"), price.alias("price")))
    nameless = F.to_json(F.struct(price.alias("price")))
    item = F.when(k % 50 == 0, F.concat(F.lit('"c'), k.cast("string"), F.lit('"'))).when(k % 41 == 0, nameless).otherwise(whole)
    # a file's customers, a hundred at most
    files = table(spark, sf, "customer").groupBy(F.floor(k / 100).alias("n")).agg(F.array_sort(F.collect_list(F.struct(k, item.alias("item")))).alias("items"))
    content = F.concat(F.lit('{"results": {"items": ['), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]}}"))
    return files.select(F.concat(F.lit("c"), F.col("n").cast("string"), F.lit(".json")).alias("name"), content.alias("content")).unionByName(
        spark.createDataFrame([("z.json", '{"results": {"items": [{"id": 1}')], "name string, content string")
    )


def _mails(spark, sf):
    """A mail for each page, in four encodings; a third are of another sender, a fifth have no link."""
    k = F.col("page_id")
    link = F.when(k % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("https://example.org/l/"), k.cast("string"), F.lit("?utm=x")))
    said = F.concat(F.lit("Appartement calme, loyer "), (800 + k % 1000).cast("string"), F.lit(" € CC, T"), (1 + k % 5).cast("string"), F.lit(" de "), (20 + k % 90).cast("string"), F.lit(",5 m² à 75011 PARIS "))
    head = F.concat(F.lit("From: "), F.when(k % 3 == 0, "Others <news@elsewhere.org>").otherwise("Alerts <Alerts@Example.org>"), F.lit("\nSubject: Annonce "), k.cast("string"), F.lit("\nMIME-Version: 1.0\n"))
    body = F.concat(said, link)
    quoted = body
    for a, b in (("=", "=3D"), ("€", "=80"), ("²", "=B2"), ("à", "=E0")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    kinds = [
        F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), body),
        F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(body, "UTF-8"))),
        F.concat(F.lit('Content-Type: multipart/alternative; boundary="B"\n\n--B\nContent-Type: text/html; charset=utf-8\n\n<p>999 €</p>\n--B\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\n'), quoted, F.lit("\n--B--\n")),
        F.concat(F.lit("Content-Type: text/html; charset=utf-8\n\n<p>"), said, F.lit('</p><a href="'), link, F.lit('">Voir</a>')),
    ]
    return texts(spark, sf, "pages").select(F.concat(F.lit("m"), k.cast("string"), F.lit(".eml")).alias("name"), F.concat(head, F.element_at(F.array(*kinds), (k % 4 + 1).cast("int"))).alias("content"))


def _sources(spark, sf) -> list[C.Source]:
    base = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    _land(_customers(spark, sf), f"{base}/json")
    _land(_mails(spark, sf), f"{base}/mail")
    _land(texts(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("content")), f"{base}/page")
    return [
        C.Source("customers", "json", f"{base}/json", FieldMap(ref=["id"], commune=["city", "address.city"], rent=["price"], charges_included=True), "private", "LIBRE", False, "customers.example", items="results.items"),
        C.Source("alerts", "mail", f"{base}/mail", sender="alerts@example.org", host="example.org", charges_included=True),
        C.Source("pages", "page", f"{base}/page", FieldMap(ref=["link"], title=["name"], url=["link"], base_url="https://pages.example"), card="nav li", selectors={"link": "a @href", "name": "a"}),
        C.Source("gone", "json", f"{base}/nothing", FieldMap(ref=["id"])),
    ]


def q_landed_listings(spark, sf):
    """All sources' listings, with what their source is known by."""
    sources = _sources(spark, sf)
    rows = state.with_profile(C.harvest(spark, sources, NOW).rows, C.profiles(spark, sources))
    return rows.select("source", "external_id", "title", "commune", "postcode", "rent_cc", "rooms", "surface_m2", "url", "family", "default_tenure", "mixed_tenure")


def q_landed_quarantine(spark, sf):
    out = C.harvest(spark, _sources(spark, sf), NOW).quarantine
    return out.select("source", F.regexp_extract("path", "[^/]*$", 0).alias("file"), "position", F.regexp_replace("error", "^(no such path:).*", "$1").alias("error"))


def q_landed_runs(spark, sf):
    """The runs that a harvest notes, its counters, and the sources' health after it."""
    sources = _sources(spark, sf)
    h = C.harvest(spark, sources, NOW)
    status = C.source_health(h.runs, sources, NOW).select("source", "status")
    counters = h.counters
    return h.runs.join(status, "source").select("source", "item_count", "ok", "at_epoch", "status", F.lit(counters["items"]).alias("items"), F.lit(counters["quarantined"]).alias("quarantined"))


def q_landed_names(spark, sf):
    """Names alone, chosen by a condition that the source gets: no mail is opened."""
    base = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    _land(_mails(spark, sf), base)
    mails = spark.read.schema("path string").format("landed").option("kind", "mail").load(base)
    return mails.filter(F.col("path").endswith("7.eml")).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"))


def q_hydrated(spark, sf):
    """Orders as listings whose details are their customers' rows; the gate wants those of unknown tenure with an even id."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    made = {
        "source": F.lit("s"), "external_id": k.cast("string"), "title": F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")), "description": F.lit(""), "rooms": F.when(k % 5 != 0, (k % 7).cast("int")),
        "fields": F.create_map(F.lit("own"), F.lit("1"), F.lit("both"), F.lit("list")), "url": F.col("o_custkey").cast("string"),
    }
    empty = C.LISTING
    rows = o.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty], F.when(k % 4 < 2, "UNKNOWN").otherwise("LLI").alias("tenure"))
    c = table(spark, sf, "customer")

    def details(wanted):
        met = wanted.select("source", "external_id", F.col("url").cast("long").alias("c_custkey")).join(c, "c_custkey")
        told = {"title": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(""), "rooms": F.when(F.col("c_custkey") % 3 == 0, 9), "fields": F.create_map(F.lit("both"), F.lit("page")), "source": F.col("source"), "external_id": F.col("external_id")}
        return met.select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty])

    gate = C.undecided() & (F.col("external_id").cast("long") % 2 == 0)
    out = C.hydrated(rows, details, gate)
    return out.select(F.col("external_id").cast("long").alias("id"), "title", "rooms", F.try_element_at("fields", F.lit("own")).alias("own"), F.try_element_at("fields", F.lit("both")).alias("both"))


#: A robots.txt of each kind, dealt to sites; the first can't be read.
ROBOTS = [
    None, "User-agent: *\nDisallow: /private/\nAllow: /private/open\n", "User-agent: *\nDisallow: /\n\nUser-agent: Other\nUser-agent: quillon\nDisallow: /b*n$\nAllow: /\n", "User-agent: *\nDisallow:\n",
    "# all\r\nUSER-AGENT: quillon # us\r\nDISALLOW: /item # none\r\nAllow: /item/1\r\nno rule\r\nCrawl-delay: 2.5\r\n", "User-agent: Other\nDisallow: /\n", "User-agent: *\nDisallow: /a+b\nDisallow: /*.pdf\nAllow: /*/open.pdf\nCrawl-delay: soon\n",
]


def q_robots(spark, sf):
    """Paths of parts on sites of suppliers, under the sites' landed robots.txt; every eighth site has none."""
    k = F.col("s_suppkey")
    files = table(spark, sf, "supplier").filter(k % 8 != 7).select(k.alias("site"), F.element_at(F.array(*[F.lit(r) for r in ROBOTS]), (k % 8 + 1).cast("int")).alias("body"))
    p = F.col("p_partkey")
    shapes = ["/private/", "/private/open/", "/b", "/item/", "", "/a+b/", "/x/", "/x/open.pdf?"]
    path = F.element_at(F.array(*[F.lit(x) for x in shapes]), (F.floor(p / 16) % 8 + 1).cast("int"))
    tail = F.when(F.floor(p / 16) % 8 == 4, "").when(p % 3 == 0, F.concat((p % 100).cast("string"), F.lit("n"))).otherwise(F.concat((p % 100).cast("string"), F.lit(".pdf")))
    paths = table(spark, sf, "part").select(p, (p % 16).alias("site"), F.concat(path, tail).alias("path"))
    out = robots.robots_allows(robots.robots_rules(files, "Quillon"), paths)
    return out.join(robots.crawl_delays(files, "quillon"), "site", "left").select("p_partkey", "site", "path", "allowed", "seconds")


def q_complete(spark, sf):
    """Sources whose pages declare more items than have landed."""
    d = table(spark, sf, "documents").select("source")
    declared = d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", (F.col("n") + F.length("source") % 2).alias("total")).unionByName(spark.createDataFrame([("none", 3)], "source string, total long"))
    return L.complete(d, declared)


def q_embedded_json(spark, sf):
    """A payload in a script element of each page, some of them broken off."""
    k = F.col("page_id").cast("string")
    script = F.concat(F.lit('<script id="__DATA__" type="application/json">{"props": {"id": '), k, F.lit(', "tags": ["a", "b"]}'), F.when(F.col("page_id") % 4 == 0, "").otherwise("}"), F.lit("</script><script>var x = {};</script>"))
    found = texts(spark, sf, "pages").select("page_id", L.embedded_json(F.concat("html", script), "__DATA__").alias("v"))
    return found.select("page_id", F.try_variant_get("v", "$.props.id", "long").alias("id"), F.try_variant_get("v", "$.props.tags[1]", "string").alias("tag"))


def q_file_channel(spark, sf):
    """Events through two channels, of which one fails; the batch that is sent again writes its files again."""
    from quillon.sources.sinks import FileChannel, notify

    class Down:
        name = "down"

        def send(self, events, batch):
            raise OSError("no route")

    out = f"{shared_folder(spark)}/sent-{uuid.uuid4().hex}"
    problems: list[str] = []
    send = notify([Down(), FileChannel(out)], lambda name, e: problems.append(name))
    o = table(spark, sf, "orders").select(F.lit("match").alias("kind"), F.lit(3).alias("priority"), F.format_string("o%08d", "o_orderkey").alias("title"), F.col("o_orderpriority").alias("text"))
    sent = [send(o, 1), send(o, 1), send(o.filter("title like '%7'"), 2)]
    read = spark.read.schema("kind string, priority int, title string, text string, batch int").json(out)
    return read.withColumn("delivered", F.lit(sum(sent))).withColumn("problems", F.lit(",".join(problems)))


#: A selector of each shape: tags, descendants, classes, ids, attributes that must be there, what is taken, patterns.
_SHAPES = {"link": "a @href", "name": "a", "letter": "a @href => /(.)", "any": "*", "rel": "[rel] @rel", "both": "p.big.red b", "by_id": "#pick", "whole": "p.red", "none": "p.blue", "tail": "b => [^ ]*$", "deep": "div p.big @data-n"}


def q_html_shapes(spark, sf):
    """A table function called from SQL over pages in a frame of our own, with selectors of every shape."""
    cards.register(spark)
    k = F.col("page_id").cast("string")
    frame = F.concat(
        F.lit('<section class="x card" id="s'), k, F.lit('" data-page="'), k, F.lit('" lang=fr>'), F.when(F.col("page_id") % 3 == 0, F.lit("<i>no link</i>")).otherwise(F.concat(F.lit("<a href='/"), k, F.lit("?a=1&amp;b=2'>Page &eacute; "), k, F.lit("</a>"))),
        F.lit('<div data-n="outer"><p class="red big" data-n="'), k, F.lit('">plain <b>bold '), k, F.lit("</b><br>end<p class=blue></div>"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<span id=pick rel=next>picked "), k, F.lit("</span>"))).otherwise(""),
        F.lit("</section><section>no card</section>"),
    )
    texts(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 10 != 9, F.concat("html", frame)).otherwise(F.lit("<p>nothing</p>")).alias("html")).createOrReplaceTempView("framed_pages")
    columns = ", ".join(f"c.`{c}`" for c in _SHAPES)
    return spark.sql(
        f"""SELECT page_id, c.position, {columns}, c.text, c.attributes['attr.id'] AS own_id, c.attributes['attr.class'] AS own_class, c.attributes['data.page'] AS page, c.attributes['data.n'] AS n, c.error
          FROM framed_pages p, LATERAL html_cards(p.html, 'section.card[lang]', '{json.dumps(_SHAPES)}') c"""
    )


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_CARDS = f"""cards AS (SELECT page_id, unnest(lis) AS li, CAST(unnest(range(len(lis))) AS INTEGER) AS position FROM (
    SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>(.*?)</li>', 1) AS lis FROM pages)),
  named AS (SELECT page_id, position, {_plain_html("regexp_extract(li, 'href=\"([^\"]*)\"', 1)")} AS link, {_plain_html("regexp_extract(li, '>([^<]*)<', 1)")} AS name FROM cards)"""
_LISTED = f"""{_CARDS}, listed AS (
  SELECT 'customers' AS source, CAST(c_custkey AS VARCHAR) AS external_id, '' AS title, c_mktsegment AS commune, NULL AS postcode, CAST(floor(abs(c_acctbal)) AS INTEGER) AS rent_cc, CAST(NULL AS BIGINT) AS rooms,
    CAST(NULL AS DOUBLE) AS surface_m2, CAST(NULL AS VARCHAR) AS url, 'private' AS family, 'LIBRE' AS default_tenure, false AS mixed_tenure FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey % 41 <> 0
  UNION ALL
  SELECT 'alerts', 'https://example.org/l/' || page_id, 'Annonce ' || page_id, NULL, '75011', 800 + page_id % 1000, 1 + page_id % 5, 20.5 + page_id % 90, 'https://example.org/l/' || page_id || '?utm=x', 'institutional', NULL, true
    FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 4
  UNION ALL SELECT 'pages', link, name, NULL, NULL, NULL, NULL, NULL, 'https://pages.example' || link, 'institutional', NULL, true FROM named),
  held AS (
  SELECT 'customers' AS source, 'c' || (c_custkey // 100) || '.json' AS file, CAST(row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS INTEGER) AS position,
    CASE WHEN c_custkey % 50 = 0 THEN 'item is no object: "c' || c_custkey || '"' WHEN c_custkey % 41 = 0 THEN 'no reference' END AS error FROM customer
  UNION ALL SELECT 'customers', 'z.json', NULL, 'JSONDecodeError: Expecting '','' delimiter: line 1 column 33 (char 32)'
  UNION ALL SELECT 'alerts', 'm' || page_id || '.eml', 0, 'no link to a listing' FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 = 4
  UNION ALL SELECT 'pages', 'p' || page_id || '.html', NULL, 'no card found' FROM pages WHERE page_id NOT IN (SELECT page_id FROM cards)
  UNION ALL SELECT 'gone', '', NULL, 'no such path:'), quarantine AS (SELECT * FROM held WHERE error IS NOT NULL)"""

ORACLES = {
    "q_landed_listings": f"WITH {_LISTED} SELECT * FROM listed",
    "q_landed_quarantine": f"WITH {_LISTED} SELECT source, CASE WHEN source <> 'gone' THEN file END AS file, position, error FROM quarantine",
    "q_landed_runs": f"""WITH {_LISTED}, runs AS (SELECT source, (SELECT count(*) FROM listed l WHERE l.source = s.source) AS item_count,
        NOT EXISTS (SELECT 1 FROM quarantine q WHERE q.source = s.source AND position IS NULL) AS ok FROM (VALUES ('customers'), ('alerts'), ('pages'), ('gone')) s(source))
      SELECT source, item_count, ok, CAST({NOW} AS BIGINT) AS at_epoch, CASE WHEN ok THEN 'OK' ELSE 'BROKEN' END AS status, (SELECT count(*) FROM listed) AS items, (SELECT count(*) FROM quarantine) AS quarantined FROM runs""",
    "q_landed_names": "SELECT 'm' || page_id || '.eml' AS file FROM pages WHERE page_id % 10 = 7",
    "q_robots": """WITH asked AS (SELECT p_partkey, p_partkey % 16 AS site, p_partkey // 16 % 8 AS s, ['/private/', '/private/open/', '/b', '/item/', '', '/a+b/', '/x/', '/x/open.pdf?'][CAST(p_partkey // 16 % 8 + 1 AS INTEGER)]
        || CASE WHEN p_partkey // 16 % 8 = 4 THEN '' WHEN p_partkey % 3 = 0 THEN p_partkey % 100 || 'n' ELSE p_partkey % 100 || '.pdf' END AS path FROM part),
      k AS (SELECT *, CASE WHEN site IN (SELECT s_suppkey FROM supplier) THEN site % 8 ELSE 7 END AS kind FROM asked)
      SELECT p_partkey, site, path, CASE kind WHEN 0 THEN false WHEN 1 THEN NOT starts_with(path, '/private/') OR starts_with(path, '/private/open') WHEN 2 THEN NOT (starts_with(path, '/b') AND ends_with(path, 'n'))
        WHEN 4 THEN NOT starts_with(path, '/item') OR starts_with(path, '/item/1') WHEN 6 THEN CASE WHEN path LIKE '/%/open.pdf%' THEN true ELSE NOT (starts_with(path, '/a+b') OR path LIKE '/%.pdf%') END ELSE true END AS allowed,
        CASE WHEN kind = 4 THEN 3 END AS seconds FROM k""",
    "q_complete": """SELECT source, count(*) + length(source) % 2 AS total, count(*) AS items FROM documents GROUP BY source HAVING length(source) % 2 = 1 UNION ALL SELECT 'none', 3, 0""",
    "q_embedded_json": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN page_id END AS id, CASE WHEN page_id % 4 <> 0 THEN 'b' END AS tag FROM pages",
    "q_file_channel": """SELECT 'match' AS kind, CAST(3 AS INTEGER) AS priority, printf('o%08d', o_orderkey) AS title, o_orderpriority AS text, CAST(b AS INTEGER) AS batch, CAST(3 AS INTEGER) AS delivered, 'down,down,down' AS problems
      FROM orders JOIN (VALUES (1), (2)) t(b) ON b = 1 OR o_orderkey % 10 = 7""",
    "q_html_shapes": """SELECT page_id, CASE WHEN f THEN CAST(0 AS INTEGER) END AS position, CASE WHEN f AND a THEN '/' || page_id || '?a=1&b=2' END AS link, CASE WHEN f AND a THEN 'Page é ' || page_id END AS name,
        CASE WHEN f AND a THEN left(CAST(page_id AS VARCHAR), 1) END AS letter, CASE WHEN f THEN CASE WHEN a THEN 'Page é ' || page_id ELSE 'no link' END END AS any, CASE WHEN f AND s THEN 'next' END AS rel,
        CASE WHEN f THEN 'bold ' || page_id END AS both, CASE WHEN f AND s THEN 'picked ' || page_id END AS by_id, CASE WHEN f THEN 'plain bold ' || page_id || ' end' END AS whole, CAST(NULL AS VARCHAR) AS none,
        CASE WHEN f THEN CAST(page_id AS VARCHAR) END AS tail, CASE WHEN f THEN CAST(page_id AS VARCHAR) END AS deep,
        CASE WHEN f THEN CASE WHEN a THEN 'Page é ' || page_id ELSE 'no link' END || ' plain bold ' || page_id || ' end' || CASE WHEN s THEN ' picked ' || page_id ELSE '' END END AS text,
        CASE WHEN f THEN 's' || page_id END AS own_id, CASE WHEN f THEN 'x card' END AS own_class, CASE WHEN f THEN CAST(page_id AS VARCHAR) END AS page, CASE WHEN f THEN CAST(page_id AS VARCHAR) END AS n,
        CASE WHEN NOT f THEN 'no card found' END AS error
      FROM (SELECT page_id, page_id % 10 <> 9 AS f, page_id % 3 <> 0 AS a, page_id % 2 = 0 AS s FROM pages)""",
    "q_hydrated": """SELECT o_orderkey AS id, CASE WHEN d AND o_custkey % 2 = 0 THEN c_name WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title,
        CASE WHEN d AND o_custkey % 3 = 0 THEN 9 WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS rooms, '1' AS own, CASE WHEN d THEN 'page' ELSE 'list' END AS both
      FROM (SELECT *, o_orderkey % 4 < 2 AND o_orderkey % 2 = 0 AND c_custkey IS NOT NULL AS d FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
}
