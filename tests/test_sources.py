import json

from quillon.sources import listings as L
from quillon.sources.sinks import ConsoleChannel, FileChannel, notify
from quillon.sources.robots import crawl_delays, robots_allows, robots_rules
from quillon.streaming.sightings import notify_once


def test_json_scan_and_mapping(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": {"items": [{"id": 7, "city": "n/c", "address": {"city": " Poissy "}, "price": "1 540,00 €", "tags": ["-", "x"]}, {"city": "no id"}]}}))
    (tmp_path / "b.json").write_text("not json")
    items = L.json_items(spark, str(tmp_path), "results.items")
    assert items.filter("error is not null").count() == 1
    fields = L.FieldMap(ref=["id"], commune=["city", "address.city"], rent=["price"], charges_included=True, title=["tags"])
    (r,) = L.map_items(items.filter("error is null"), "demo", fields).collect()
    assert (r.external_id, r.commune, r.rent_cc, r.title) == ("7", "Poissy", 1540, "x") and r.fields["address.city"] == " Poissy "
    assert L.unmapped_items(items.filter("error is null"), fields).count() == 1


def test_html_cards(spark):
    page = '<div class="card big" data-x="1"><h2>A &amp; B</h2><a href="/1">go <b>on</b></a><i data-y="2">t</i></div><div class="other"><h2>no</h2></div>'
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string")
    rows = {r.page_id: r for r in L.html_cards(df, "div.card", {"title": "h2", "url": "a @href", "n": "a @href => /(\\d+)", "none": "p"}).collect()}
    assert rows[1].item == {"title": "A & B", "url": "/1", "n": "1", "_text": "A & B go on t", "attr.class": "card big", "data.x": "1", "data.y": "2"}
    assert rows[2].error and rows[3].error


def test_mail(spark, tmp_path):
    raw = (
        b"From: Alerte <a@site.example>\r\nSubject: =?utf-8?q?Nouveau_T3_=C3=A0_Poissy?=\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n"
        b"Loyer : 1 200 =80 CC, 70 m2, T3, 78300 Poissy\r\nhttps://site.example/annonce/5?x=3D1.\r\nhttps://site.example/unsubscribe\r\n"
    )
    (tmp_path / "1.eml").write_bytes(raw)
    mail = L.mails(spark, str(tmp_path))
    (r,) = L.mail_listings(mail, "alerts", sender="SITE.example", places={"poissy": "Poissy"}, charges_included=True).collect()
    assert (r.external_id, r.title, r.rent_cc, r.rooms, r.surface_m2, r.postcode, r.commune) == ("https://site.example/annonce/5", "Nouveau T3 à Poissy", 1200, 3, 70.0, "78300", "Poissy")


def test_robots(spark):
    rules = spark.createDataFrame([("s", "/a", False), ("s", "/a/b", True), ("s", "/*.pdf$", False), ("s", "/a/b", False), ("t", "/", False)], "site string, pattern string, allow boolean")
    paths = spark.createDataFrame([("s", p) for p in ("/", "/a/x", "/a/b/c", "/x.pdf", "/x.pdf?y")] + [("t", "/t"), ("u", "/u")], "site string, path string")
    want = {"/": True, "/a/x": False, "/a/b/c": True, "/x.pdf": False, "/x.pdf?y": True, "/t": False, "/u": True}
    assert {r.path: r.allowed for r in robots_allows(rules, paths).collect()} == want


def test_robots_files(spark):
    bodies = {
        "late": "User-agent: *\nDisallow: /\n\nUser-agent: a\nUser-agent: Quill\nDisallow: /x\nCrawl-delay: 1.2\n# end", "open": "User-agent: *\nDisallow:\n", "none": "", "other": "User-agent: b\nDisallow: /\n",
        "split": "User-agent: quillon\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n\nUser-agent: quillon\nAllow: /x/y\nnonsense\nCrawl-delay: soon\nCrawl-delay: 3", "lost": None, "cr": "user-AGENT : *\r  disallow:/x # no \rAllow: /x/y",
    }
    files = spark.createDataFrame(list(bodies.items()), "site string, body string")
    rules = {(r.site, r.pattern, r.allow) for r in robots_rules(files, "Quillon").collect()}
    assert rules == {("late", "/x", False), ("split", "/x", False), ("split", "/x/y", True), ("lost", "/", False), ("cr", "/x", False), ("cr", "/x/y", True)}
    assert {tuple(r) for r in crawl_delays(files, "quillon").collect()} == {("late", 2), ("split", 3)}
    paths = spark.createDataFrame([(s, p) for s in bodies for p in ("", "/x/y", "/x")] + [("late", "/x")], "site string, path string")
    denied = [(r.site, r.path) for r in robots_allows(robots_rules(files, "Quillon"), paths).collect() if not r.allowed]
    assert sorted(denied) == [("cr", "/x"), ("late", "/x"), ("late", "/x"), ("late", "/x/y"), ("lost", ""), ("lost", "/x"), ("lost", "/x/y"), ("split", "/x")]


def test_embedded_json(spark):
    page = '<script>no</script><script id="data" type="x">{"items": [1]}</script>'
    from pyspark.sql import functions as F

    (r,) = spark.createDataFrame([(page,)], "html string").select(F.to_json(L.embedded_json(F.col("html"), 'id="data"')).alias("j")).collect()
    assert r.j == '{"items":[1]}'


def test_incomplete_sources(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "source string, item int")
    declared = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "source string, total int")
    assert {(r.source, r["items"]) for r in L.complete(pages, declared).collect()} == {("b", 1), ("c", 0)}


def test_failures_stay_apart(spark):
    def bad():
        raise OSError("gone")

    lazy = lambda: spark.range(3).selectExpr("id + raise_error('no such page') AS id")
    rows, errors = L.gather({"good": lambda: spark.range(3), "bad": bad, "lazy": lazy, "more": lambda: spark.range(2)})
    assert rows.count() == 5 and errors[0] == ("bad", "OSError: gone") and errors[1][0] == "lazy" and len(errors) == 2


def test_notifications_are_sent_once(spark, tmp_path):
    events = spark.createDataFrame([("k1", "match", 3, "t", "x")], "key string, kind string, priority int, title string, text string")
    sent = []

    class Broken:
        name = "broken"

        def send(self, e, b):
            raise OSError("no")

    send = notify([Broken(), ConsoleChannel(), FileChannel(str(tmp_path / "out"))], lambda n, e: sent.append(n))
    assert notify_once(events, str(tmp_path / "ledger"), 1, send) and sent == ["broken"]
    assert not notify_once(events, str(tmp_path / "ledger"), 2, send)
    assert not notify_once(events, str(tmp_path / "none"), 1, notify([Broken()]))
    assert not (tmp_path / "none").exists()


def test_the_console_prints_all_events(spark, capsys):
    from quillon.sources.sinks import event_rows

    rows = [("s", "MATCH", f"m{i}", "t", False, True, False) for i in range(250)] + [("s", "DIGEST", f"d{i:04}", "t", False, True, False) for i in range(1100)]
    judged = spark.createDataFrame(rows, "source string, outcome string, headline string, text string, high_priority boolean, is_new_match boolean, rent_drop boolean")
    events = event_rows(judged)
    ConsoleChannel().send(events, 1)
    out = capsys.readouterr().out
    assert all(f"m{i}: t" in out for i in range(250)) and all(f"d{i:04}" in out for i in range(1100))
    assert sorted(r.title for r in events.filter("kind = 'digest'").collect()) == ["digest of s", "digest of s, 2", "digest of s, 3"]


def test_kept_tables_are_discarded(spark):
    import os

    from quillon import shared

    shared.discard(spark)
    df = shared.kept(spark.range(3), "three")
    (path,) = (x.removeprefix("file:") for x in shared._written)
    assert df.count() == 3 and os.path.isdir(path) and shared.discard(spark) == 1 and not os.path.exists(path)


def test_references_cut_off_stay_as_they_are(spark):
    page = '<head><title>R &amp; D &lt;b &eacute; A&B &copy=2 and&amp</title></head><a href="/?a=1&copy=2&amp;b=3">x</a>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    (r,) = L.html_cards(df, "head", {"title": "title"}).collect()
    assert r.item["title"] == "R & D <b é A&B &copy=2 and&amp"
    (r,) = L.html_cards(df, "a", {}).collect()
    assert r.item["attr.href"] == "/?a=1&copy=2&b=3"


def test_a_page_leaves_nothing_for_the_collector():
    import gc

    page = "<ul>" + '<li><a href="/1">x</a></li>' * 300 + "</ul>"
    gc.collect()
    gc.disable()
    try:
        assert len(list(L.card_items(page, L.Selector.parse("li a"), {}))) == 300
        assert gc.collect() < 300
    finally:
        gc.enable()
