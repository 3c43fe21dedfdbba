"""The landed data source, source contracts, harvests with quarantine, and the gate before detail pages."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.schema import LISTING
from quillon.sources import cards, landed
from quillon.sources import contract as C
from quillon.sources.listings import FieldMap


@pytest.fixture
def land(spark, tmp_path):
    landed.register(spark)

    def put(folder, **files):
        rows = [(k.replace("__", "."), v) for k, v in files.items()]
        spark.createDataFrame(rows, "name string, content string").write.format("landed").mode("append").option("path", f"{tmp_path}/{folder}").save()
        return f"{tmp_path}/{folder}"

    return put


def scan(spark, path, **options):
    return spark.read.format("landed").options(**options).load(path)


def test_bad_items_lines_and_files_cost_their_own_rows_alone(spark, land):
    path = land("j", a__json='{"x": {"items": [{"id": 1}, 7, {"id": null}, null]}}', b__json="{", c__json='{"x": []}', d__json='{"x": {"items": {"id": 1}}}')
    rows = [(r.path[-6:], r.position, r.item, r.error and r.error.split(":")[0]) for r in scan(spark, path, items="x.items").collect()]
    assert sorted(rows, key=repr) == sorted(
        [("a.json", 0, '{"id": 1}', None), ("a.json", 1, None, "item is no object"), ("a.json", 2, '{"id": null}', None), ("a.json", 3, None, "item is no object"), ("b.json", None, None, "JSONDecodeError"), ("c.json", None, None, "ValueError"), ("d.json", None, None, "ValueError")],
        key=repr,
    )
    path = land("l", a__txt='[{"id": 1}]\n\n{oops\n[{"id": 2}, {"id": 3}]\n')
    assert [(r.position, r.item is None) for r in scan(spark, path, lines="true").orderBy("position").collect()] == [(0, False), (1, True), (2, False), (3, False)]


def test_names_decide_before_contents_are_read(spark, land, tmp_path):
    path = land("m", **{f"m{i}__eml": f"From: a@b.org\nSubject: s{i}\n\nhttps://b.org/{i}" for i in range(30)}, other__txt="no mail", _hidden__eml="x")
    assert scan(spark, path, kind="mail").count() == 30
    newest = scan(spark, path, kind="mail", newest="3").select(F.get_json_object("item", "$.subject").alias("s")).collect()
    assert sorted(r.s for r in newest) == ["s7", "s8", "s9"]  # by name, not by number
    (tmp_path / "m" / "m5.eml").chmod(0)
    reader = landed.LandedReader({"path": path, "kind": "mail"}, ["path"])
    left = list(reader.pushFilters([landed.StringEndsWith(("path",), "5.eml"), landed.EqualTo(("error",), "x"), landed.In(("path",), (f"{path}/m5.eml", f"{path}/m6.eml"))]))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    (part,) = reader.partitions()
    assert part.paths == [f"{path}/m5.eml"] and [b.to_pylist() for b in reader.read(part)] == [[{"path": f"{path}/m5.eml"}]]
    assert landed.LandedReader({"path": f"{path}/none"}, ["error"]).partitions()[0].problem.startswith("no such path")


def test_files_are_packed_into_partitions(land, monkeypatch):
    path = land("p", **{f"f{i}__json": "[" + "1," * 40 + "1]" for i in range(10)})
    monkeypatch.setattr(landed, "PART_BYTES", 250)
    assert [len(p.paths) for p in landed.LandedReader({"path": path}, ["item"]).partitions()] == [3, 3, 3, 1]
    monkeypatch.setattr(landed, "PART_FILES", 2)
    assert [len(p.paths) for p in landed.LandedReader({"path": path}, ["item"]).partitions()] == [2] * 5


def test_a_source_says_what_it_is():
    ref = FieldMap(ref=["id"])
    s = C.Source("a", "json", "/x", ref, "private", "LIBRE", False)
    assert s.profile() == ("a", "private", "LIBRE", False)
    for bad in ({"kind": "ftp"}, {"family": "else"}, {"default_tenure": "NONE"}, {"fields": None}, {"name": ""}, {"kind": "page"}):
        with pytest.raises(ValueError, match="source"):
            C.Source(**({"name": "a", "kind": "json", "path": "/x", "fields": ref} | bad))


def test_harvest(spark, land):
    items = json.dumps([{"id": i, "t": f"T{i}", "p": "900 €"} for i in range(5)] + [{"t": "nameless"}, "x"])
    sources = [
        C.Source("good", "json", land("good", a__json=items), FieldMap(ref=["id"], title=["t"], rent=["p"], charges_included=True)),
        C.Source("broken", "json", land("broken", a__json=items, b__json="{"), FieldMap(ref=["id"]), "private"),
        C.Source("empty", "json", land("empty", a__json="[]"), FieldMap(ref=["id"])),
        C.Source("bad", "json", land("bad", a__json="[1, 2]"), FieldMap(ref=["id"])),
        C.Source("gone", "mail", "/nothing/there"),
        C.Source("mail", "mail", land("mail", a__eml="From: x@y.org\n\nLoyer 800 € cc https://y.org/1 https://y.org/2", b__eml="From: x@y.org\n\nno link", c__eml="From: z@z.org\n\nhttps://y.org/3"), sender="y.org", charges_included=True),
    ]
    h = C.harvest(spark, sources, 50, 3)
    runs = {r.source: (r.item_count, r.ok, (r.error or "").split(":")[0], r.at_epoch, r.seq) for r in h.runs.collect()}
    assert runs == {
        "good": (5, True, "no reference", 50, 3), "broken": (5, False, "no reference", 50, 3), "empty": (0, True, "", 50, 3), "bad": (0, False, "item is no object", 50, 3),
        "gone": (0, False, "no such path", 50, 3), "mail": (2, True, "no link to a listing", 50, 3),
    }
    assert h.counters == {"items": 12, "quarantined": h.quarantine.count()} and h.rows.count() == 12
    assert h.rows.columns == [f.name for f in LISTING] + ["seq"] and h.rows.select("seq").distinct().count() == 12
    assert {(r.source, r.family) for r in C.profiles(spark, sources).collect()} >= {("broken", "private"), ("mail", "institutional")}
    status = {r.source: r.status for r in C.source_health(h.runs, sources, 60).collect()}
    assert status["good"] == "OK" and status["gone"] == "BROKEN"
    with pytest.raises(ValueError, match="one name"):
        C.profiles(spark, sources[:1] * 2)


def test_details_need_a_gate(spark):
    rows = spark.createDataFrame([("s", str(i), "t", "", {}, None, None, None, None, None, None, i, None, None, None, None, "UNKNOWN" if i < 2 else "LLI") for i in range(4)], StructType([*LISTING.fields, StructField("tenure", StringType())]))
    asked = []

    def details(wanted):
        asked.extend(r.external_id for r in wanted.collect())
        return wanted.select(*[F.lit(9).alias("rooms") if f.name == "rooms" else F.col(f.name) for f in LISTING])

    with pytest.raises(ValueError, match="gate"):
        C.hydrated(rows, details, None)
    assert C.hydrated(rows, None, None) is rows
    out = {r.external_id: r.rooms for r in C.hydrated(rows, details, C.undecided()).collect()}
    assert sorted(asked) == ["0", "1"] and out == {"0": 9, "1": 9, "2": 2, "3": 3}
    assert C.hydrated(rows, details, F.lit(None).cast("boolean")).filter("rooms = 9").count() == 0


def test_html_table_function(spark):
    cards.register(spark)
    page = '<ul><li class="a b" data-k="1"><a href="/x">One</a></li><li class="a"><a>Two</a><i data-k="2" data-z="3"></i></li></ul>'
    spark.createDataFrame([(1, page), (2, "<p>"), (3, None)], "id int, html string").createOrReplaceTempView("t_pages")
    call = lambda card, selectors: spark.sql(f"SELECT id, c.* FROM t_pages p, LATERAL html_cards(p.html, {card}, {selectors}) c")
    out = call("'li.a'", """'{"to": "a @href", "name": "a => ^(.)", "both": ".b a"}'""")
    assert out.columns == ["id", "position", "to", "name", "both", "text", "attributes", "error"]
    assert sorted(map(tuple, out.collect())) == [
        (1, 0, "/x", "O", "One", "One", {"attr.class": "a b", "data.k": "1"}, None), (1, 1, None, "T", None, "Two", {"attr.class": "a", "data.k": "2", "data.z": "3"}, None),
        (2, None, None, None, None, None, None, "no card found"), (3, None, None, None, None, None, None, "no card found"),
    ]
    for card, selectors, said in [("'li'", "html", "constant"), ("'li >> a'", "'{}'", "not understood"), ("'li'", "'[1]'", "JSON object"), ("'li'", """'{"text": "a"}'""", "other than"), ("'li'", "'{'", "JSON object")]:
        with pytest.raises(Exception, match=said):
            call(card, selectors).collect()


def test_what_has_landed_is_scanned_once(spark, tmp_path):
    from quillon.sources import landed as scans
    from quillon.sources.contract import Source
    from quillon.sources.listings import FieldMap

    scans.register(spark)
    (tmp_path / "a.json").write_text('[{"id": 1}, {}, 2]')
    for source in (Source("j", "json", str(tmp_path), FieldMap(ref=["id"])), Source("m", "mail", str(tmp_path), sender="x", host="h")):
        assert source.listings(spark)._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1
