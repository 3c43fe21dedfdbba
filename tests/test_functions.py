import pytest
from pyspark.sql import functions as F

from quillon.functions import extract as X
from quillon.functions import text as S
from quillon.functions.redact import redact


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(column(F.col("s"))).collect()]


def test_fold(spark):
    assert one(spark, S.fold, "Élégant  Cœur d’Île\r\n\n  Straße", "a​b", None, "caf&eacute;", "") == ["elegant coeur d'ile\nstrasse", "ab", None, None, ""]
    assert one(spark, S.fold_keep_case, "ÉTÉ ŒUVRE") == ["ETE OEUVRE"]
    assert one(spark, S.fold_tolerant, "caf&amp;eacute;") == ["cafe"]


def test_tokens(spark):
    at = lambda n: lambda c: S.token_position(c, n)
    assert one(spark, at("lli"), "un lli ici", "alli", None, "") == [3, None, None, None]
    form = lambda n: lambda c: S.inflected_position(c, n)
    assert one(spark, form("logement social"), "logements sociaux", "logementsocial", "logement\nsociales", "logements") == [0, 0, 0, None]


@pytest.mark.parametrize(
    ("raw", "value"),
    [("1 540,00 €", 1540.0), ("1.234", 1234.0), ("91,5", 91.5), ("1,234.56", 1234.56), ("-12", -12.0), ("env. 800 m", 800.0), ("", None), ("abc", None), ("1 200", 1200.0), ("1.234.567", 1234567.0)],
)
def test_number(spark, raw, value):
    assert one(spark, X.number, raw) == [value]


def test_whole_floor_flag(spark):
    assert one(spark, X.whole, "2,5", "-2,5", None) == [3, -3, None]
    assert one(spark, X.floor_level, "RDC", "3ème étage", "0", "?", None) == [0, 3, 0, None, None]
    assert one(spark, X.flag, "Oui", "NON", "peut-être", "présent", None) == [True, False, None, True, None]
    assert one(spark, X.is_nullish, " N/C ", "non communiqué", "x", None) == [True, True, False, True]


def test_urls_and_keys(spark):
    assert one(spark, S.normal_url, "HTTPS://Me@Ex.ORG:8/A?b=C#d", " Pas une URL ") == ["https://Me@ex.org:8/A?b=C", "pas une url"]
    df = spark.createDataFrame([("s", " 7 ", None, "t"), ("s", None, "http://A/b", "T"), ("s", "", None, "")], "a string, b string, c string, d string")
    keys = [r[0] for r in df.select(S.dedup_key(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert keys[0] == "s:id:7" and keys[1].startswith("s:h:") and keys[2] is None


def test_iso_epoch(spark):
    assert one(spark, S.iso_epoch, "1970-01-02T00:00:00Z", "1970-01-01T02:00:00.1234567+02:00", "2024-02-30T00:00:00Z", "2024-01-01T00:00:00", None) == [86400, 0, None, None, None]


@pytest.mark.parametrize(
    ("raw", "gone"),
    [
        ("see https://me:pw@host/x", "me:pw"), ("password=hunter2 next", "hunter2"), ("Authorization: Bearer abcdefgh12345", "abcdefgh12345"), ("mail a.b@c.org now", "a.b@c.org"),
        ("LOGIN user secretword", "secretword"), ("key=abc123", "abc123"), ("RFR : 23 456", "456"), ('{"topic":"mytopic"}', "mytopic"),
        ("dbPassword=hunter2", "hunter2"), ("PASS hunter2", "hunter2"), ("bot 123456789:" + "Ab1_" * 9, "Ab1_"), ("x https://ntfy.sh/my-topic?x", "my-topic"), ("tokenValue => 'a b c'", "a b c"),
        ("AUTHENTICATE PLAIN abc=", "abc"), ("blob " + "Ab1/" * 8 + "== end", "Ab1/"), ("+ " + "Ab1/" * 8 + "\nnext", "Ab1/"), ("SMTP_PASS: 'p w'", "p w"), ("mot de passe = azerty", "azerty"),
    ],
)
def test_redact(spark, raw, gone):
    (out,) = one(spark, redact, raw)
    assert gone not in out and "[masked]" in out


def test_redact_leaves_text(spark):
    texts = ["LOGIN failed: the key was not found", "compass: north", "the tokens: 3", "monkey=banana", "https://host/a:b@c", "a long_identifier_name_of_this_kind=value", None]
    assert one(spark, redact, *texts) == texts
    assert one(spark, redact, "password=[masked] and Bearer [masked]") == ["password=[masked] and Bearer [masked]"]
    assert one(spark, lambda c: redact(c, ["abcd", "abcdef", "xy"]), "abcdef xy") == ["[masked] xy"]


def test_sniffers(spark):
    assert one(spark, X.sniff_rent, "Loyer : 1 250,50 € hors charges, soit 1 400 € / mois CC", "prix 950 euros, dépôt 1900 EUR", "frais 90 €, loyer 850€", "12 €", "rien", None) == [1400, 950, 850, None, None, None]
    assert one(spark, X.sniff_surface, "T3 de 62,5 m² au 2e", "3 m2", "m² 45 m^2", None) == [62.5, None, 45.0, None]
    assert one(spark, X.sniff_rooms, "Appartement T 4", "F2 meublé", "4 pièces", "3 pieces T2", "T0", "néant") == [4, 2, 4, 3, None, None]
    assert one(spark, X.sniff_postcode, "à 92100 Boulogne", "13001 Marseille 75011 Paris", "750112") == ["92100", "75011", None]


def test_flatten_in_the_jvm(spark):
    from pyspark.sql import functions as F

    from quillon.functions.extract import flatten_json

    deep = '{"a": ' * 12 + '[1, [2]]' + "}" * 12
    rows = [
        ('{"x": {"y": null, "z": [true, {"w": "s"}, [], {}]}, "n": 1.50, "e": 1e3, "é": "", "x.z.0": 5, "big": 12345678901234567890}', {"x.z.0": "true", "x.z.1.w": "s", "n": "1.5", "e": "1000.0", "é": "", "big": "12345678901234567890"}),
        ("[1, {\"a\": 2}]", {"0": "1", "1.a": "2"}), ("{}", {}), ('"text"', {}), ("3", {}), ("null", {}), ("{oops", None), ("", None), (None, None), (deep, {".".join("a" * 12) + ".0": "1"}),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, s string").select("i", flatten_json(F.col("s")).alias("m"))
    assert [r.m for r in df.orderBy("i").collect()] == [m for _, m in rows]
    assert "Python" not in df._jdf.queryExecution().toString()


def test_events_are_flattened_in_tasks_of_bounded_rows(spark, monkeypatch):
    from conftest import SMALL
    from quillon.plans import queries_text, tables

    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    assert queries_text._nested(spark, SMALL).rdd.getNumPartitions() >= 10
