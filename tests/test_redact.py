"""What goes and what stays, message by message."""

import pytest
from pyspark.sql import functions as F

from quillon.functions.redact import MASK, redact

#: (message, what must be gone); in our own words, one for each kind of secret and spelling.
GONE = [
    ("GET https://maps.example/v1/route?apikey=q7W8e9R&from=home", ["q7W8e9R"]), ("https://api.example/find?key=v4lueOfIt", ["v4lueOfIt"]), ("denied: access_token=aa.bb-cc.dd", ["aa.bb-cc.dd"]), ("connect password=swordfish9", ["swordfish9"]),
    ('{"client_secret": "zyxw98765"}', ["zyxw98765"]), ("imaps://anna:swordfish9@mail.example/INBOX", ["swordfish9", "anna"]), ("Authorization: Bearer abc.def.ghi1", ["abc.def.ghi1"]), ("Authorization: Basic YW5uYTpwdw", ["YW5uYTpwdw"]),
    ("LOGIN failed for anna.b@mail.example", ["anna.b@mail.example"]), ("?sig=0a1b2c3d&page=4", ["0a1b2c3d"]), ("B7 NO denied in: B7 LOGIN anna@mail.example Swordfish", ["Swordfish"]), ("-ERR refused: PASS Swordfish", ["Swordfish"]),
    ("open(): failed user=anna host=mail.example pass=Swordfish", ["Swordfish"]), ("404 https://api.telegram.org/bot556677:AAbbCC_dd-ee/getMe", ["AAbbCC_dd-ee", "556677"]), ("https://api.telegram.org:443/file/bot556677:AAbb/photos/1.jpg", ["AAbb"]),
    ("500 https://ntfy.sh/annas-flat-77", ["annas-flat-77"]), ("https://ntfy.home.example:8080/annas_flat", ["annas_flat"]), ("plafond : RFR N-2 = 38 900 €", ["38 900"]), ("RFR_N2=38900 trop haut", ["38900"]), ("revenu fiscal de référence : 38\u202f900", ["900"]),
    ("IMAP_PASSWORD=swordfish9", ["swordfish9"]), ("SMTP_PASSWORD2=swordfish9", ["swordfish9"]), ("SMTP_PASSWORD_2=swordfish9", ["swordfish9"]), ("my2password=swordfish9", ["swordfish9"]), ("TELEGRAM_BOT_TOKEN=5566778899:AAbbCC no", ["AAbbCC"]),
    ("MAPS_API_KEY=qq77WW refused", ["qq77WW"]), ("NTFY_TOPIC=annas-flat", ["annas-flat"]), ("password='swordfish9' no", ["swordfish9"]), ("array ( 'user' => 'a', 'password' => 'swordfish9', )", ["swordfish9"]), ('password="four plain old words"', ["plain old"]),
    ("401 for 5566778899:AAbbCCddEEffGGhhIIjjKKllMMnnOOpp_q", ["AAbbCCddEE"]), ("sent: AUTH PLAIN AGFubmEAc3dvcmRmaXNoOQ==", ["AGFubmEA"]), ("sent: AUTH PLAIN AGFubmEAc3dvcmRmaXNoOTk", ["AGFubmEA"]), ("535 failed: AGFubmEAc3dvcmRmaXNoOTk5OQ==", ["AGFubmEA"]),
    ("auth=swordfish9 no", ["swordfish9"]), ("session=77aa88bb over", ["77aa88bb"]), ("mot de passe: swordfish9 faux", ["swordfish9"]), ("motdepasse=swordfish9", ["swordfish9"]), ('{"e":"x","clientSecret":"sw-0rd"}', ["sw-0rd"]), ('{"accessToken":"sw.0rd"}', ["sw.0rd"]),
    ('{"refreshToken":"sw-0rd"}', ["sw-0rd"]), ("'botToken' => 'AAb-11'", ["AAb-11"]), ("userPassword: swordfish9", ["swordfish9"]), ("clientSecretKey=sw0rd", ["sw0rd"]), ("secretValue=sw0rd", ["sw0rd"]), ('{"topic":"annas-flat"}', ["annas-flat"]),
    ("IMAP: > B7 LOGIN anna@mail.example swordfish (try 2)", ["swordfish"]), ("POP3 : PASS swordfish — look", ["swordfish"]), ("00012345 LOGIN anna swordfish9", ["swordfish9"]), ("LOGIN anna swordfish9", ["swordfish9"]), ('imap: LOGIN "anna" "sword fish"', ["sword fish"]),
    ("b7 AUTHENTICATE PLAIN c3dvcmQ", ["c3dvcmQ"]), ("CLIENT -> SERVER: c3dvcmRmaXNoQWJj", ["c3dvcmRmaXNoQWJj"]), ("334 UGFz\r\nc3dvcmRmaXNoQWJj\r\n535 no", ["c3dvcmRmaXNoQWJj"]), ("CLIENT -> SERVER: c3dvcmRmaXNoYWJjZGVmZw==", ["c3dvcmRmaXNo"]),
    ("334 UGFz\nc3dvcmRmaXNoQWJj\n535 no", ["c3dvcmRmaXNoQWJj"]), ("b7 LOGIN anna swordfish9\r\nb8 NO\r\n", ["swordfish9"]), ("callback: key=https://x.example/hook?apikey=sw0rd", ["sw0rd"]),
]

#: (message, what must stay): what says what went wrong.
STAYS = [
    ("error auth: https://x.example/api/find gave 403", ["https://x.example/api/find", "403"]), ("config line 3 : key: rooms is no list", ["rooms", "line 3"]), ("Login failed for user=anna host=mail.example", ["Login failed for", "mail.example"]),
    ("GET https://x.example:8443/api?back=a@b.example late", ["x.example:8443", "/api"]), ("refused: key=https://x.example/hook?apikey=sw0rd", ["https://x.example/hook"]), ("-ERR PASS command given too early", ["PASS command given"]),
    ("LOGIN refusé par mail.example", ["refusé", "mail.example"]), ("Login to mail.example:993 failed", ["mail.example:993"]), ("carte Pass Navigo inconnue", ["Pass Navigo"]), ("pass 3 of 4 : 12 flats", ["pass 3 of 4", "12 flats"]),
    ("AUTHENTICATE XOAUTH2 rejected, PLAIN only", ["XOAUTH2 rejected"]), ("JSON at 77: unexpected token: }", ["unexpected token: }"]), ("GET https://x.example/f?aVeryLongParameterNameInCamelCase=flat", ["aVeryLongParameterNameInCamelCase=flat"]),
    ("unknown field: someLongFieldNameNumber2InThere x", ["someLongFieldNameNumber2InThere"]), ("échec LOGIN sur mail.example", ["LOGIN sur mail.example"]), ("b7 BAD AUTHENTICATE mechanism unknown", ["mechanism unknown"]), ("-ERR PASS required", ["PASS required"]),
    ("-ERR PASS erreur de forme", ["PASS erreur de forme"]), ("-ERR PASS Command too early", ["PASS Command too early"]), ("-ERR PASS refusé ici", ["PASS refusé ici"]), ("IMAP:\nAUTHENTICATIONERROR!\nno", ["AUTHENTICATIONERROR"]), ("IMAP:\nAUTHENTICATIONFAILED\nno", ["AUTHENTICATIONFAILED"]),
    ("found:\nconventionnement\nthere", ["conventionnement"]), ("lost:\nsome/where/over/that\nstop", ["some/where/over/that"]), ("sum\n" + "0a1b2c3d" * 8 + "\nelse", ["0a1b2c3d" * 8]), ("PASSAGE=closed on 4", ["PASSAGE=closed"]), ("SIGNAL=SIGHUP seen", ["SIGNAL=SIGHUP"]),
    ("passerelle=proxy-2", ["passerelle=proxy-2"]), ("robots bypass: refused here", ["bypass: refused here"]), ("class:\nSomeRatherLongClassName\nx", ["SomeRatherLongClassName"]), ("got: pass invalide", ["pass invalide"]), ("rent=1450 costs=120 area=68", ["rent=1450", "costs=120", "area=68"]),
    ("nothing to hide", ["nothing to hide"]),
]


@pytest.fixture(scope="module")
def masked(spark):
    every = [m for m, _ in GONE + STAYS]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(every)], "i int, m string").select("i", redact(F.col("m")).alias("m"), redact(redact(F.col("m"))).alias("again"))
    rows = sorted(df.collect())
    return dict(zip(every, ((r.m, r.again) for r in rows), strict=True))


@pytest.mark.parametrize(("message", "secrets"), GONE, ids=range(len(GONE)))
def test_secrets_go(masked, message, secrets):
    assert all(s not in masked[message][0] for s in secrets) and MASK in masked[message][0], masked[message][0]


@pytest.mark.parametrize(("message", "told"), STAYS, ids=range(len(STAYS)))
def test_what_went_wrong_stays(masked, message, told):
    assert all(t in masked[message][0] for t in told), masked[message][0]


def test_masked_twice_is_masked_once(masked):
    assert all(a == b for a, b in masked.values())


def test_nulls_literals_and_marks(spark):
    df = spark.createDataFrame([(None,), ("",), ("my own word is swordfish",), ("\x01 \x02x\x02 stays readable",)], "m string")
    out = [r[0] for r in df.select(redact(F.col("m"), ["swordfish", "own", "swordfish is"])).collect()]
    assert out[:3] == [None, "", f"my own word is {MASK}"] and "stays readable" in out[3]
