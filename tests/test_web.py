"""HTML, URL and payload transforms on small cases."""

from pyspark.sql import functions as F

from palisade.functions.patterns import java, re2
from palisade.operators import payloads, state, web


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_patterns_translate():
    assert java(r"\bslot$") == "(?i)" + java(r"\b")[4:] + r"slot\z"
    assert java(r"[\s._]") .startswith(r"(?i)[\s") and "[[" not in java(r"[\s._]")
    assert re2(r"\ba[\s\S]{0,3}b\/") == r"\ba(?s:.){0,3}b/"


def test_borders_are_ascii(spark):
    for text, want in (("жslot", True), ("slot", True), ("x slot.", True), ("slots", False), ("slot_", False)):
        assert one(spark, F.col("t").rlike(java(r"\bslot\b")), t=text) is want


def test_parse_edges(spark):
    assert one(spark, payloads.parse_saweria(F.col("r")), r='{"type":"donation","data":[{"donator":5,"message":null}]}')[0].asDict() == {"donator": "", "message": "", "amount": 0.0, "currency": ""}
    assert one(spark, payloads.parse_saweria(F.col("r")), r='{"type":"donation","data":{}}') is None
    assert one(spark, payloads.parse_bagibagi(F.col("r")), r='{"target":"Donation","arguments":[{"preferedName":"p","username":"u","amount":"x"}]}\x1e')[0].donator == "p"
    assert one(spark, payloads.parse_sociabuzz(F.col("r")), r='{"action":15,"messages":[{"data":{"fullname":"f","amount":"12abc"}},{"data":"{\\"note\\":\\"n\\"}"}]}')[0].amount == 12
    assert one(spark, payloads.parse_sociabuzz(F.col("r")), r='{"action":15,"messages":[{"data":"broken"}]}') is None
    assert one(spark, payloads.parse_tako(F.col("r")), r='{"result":{"sender":{"name":"n"},"message":"m","amount":3}}')[0].amount == 3
    assert one(spark, payloads.parse_tako(F.col("r")), r='{"result":{"message":"m"}}') is None


def test_rewrites_keep_unknown_fields():
    assert payloads.rewritten("bagibagi", '{"target":"Donation","arguments":[{"username":"u","k":1}]}\x1e', "D", "M") == '{"target":"Donation","arguments":[{"username":"D","k":1,"preferedName":"D","message":"M","audioData":null}]}\x1e'
    assert payloads.rewritten("sociabuzz", '{"messages":[{"data":{"note":"n","tts":1,"z":2}}]}', None, "M") == '{"messages":[{"data":"{\\"note\\":\\"M\\",\\"z\\":2}"}]}'
    assert payloads.rewritten("saweria", "junk", "D", "M") == "junk" and payloads.rewritten("other", "{}", "D", "M") == "{}"


def test_html(spark):
    html = '<html><head a="b"><script type="0a1-module" crossorigin="x"></script><script src="/cdn-cgi/a.js">1</script></head><body></head>'
    out = one(spark, web.strip_artefacts(F.col("h"), F.lit("https://tako.id")), h=html)
    assert out == '<html><head a="b"><script type="module"></script></head><body></head>'
    assert one(spark, web.inject_head(F.col("h"), F.lit("$1"), F.lit(False)), h=out).startswith('<html><head a="b"><script type="module"></script>$1</head><body>')
    assert one(spark, web.inject_head(F.col("h"), F.lit("$1"), F.lit(True)), h=out).startswith('<html><head a="b">$1<script')
    assert one(spark, web.inject_head(F.col("h"), F.lit("x"), F.lit(True)), h="none") == "none"


def test_urls(spark):
    assert one(spark, web.backend_target(F.col("u"), F.lit("tako"), F.lit("https://tako.id/api")), u="/backend/tako/api/a?x=1&streamKey=k&overlayType=alert") == "https://tako.id/api/a?x=1"
    assert one(spark, web.resolve_platform(F.col("c"), F.col("r")), c="moderation_platform=tako", r=None) == "tako"
    assert one(spark, web.resolve_platform(F.col("c"), F.col("r")), c=None, r="http://h/?platform=bagibagi") == "bagibagi"
    assert one(spark, web.resolve_platform(F.col("c"), F.col("r")), c="moderation_platform=nobody", r=None) == "saweria"
    assert one(spark, web.mime_of(F.col("p")), p="/a/b.svg?x") == "image/svg+xml"


def test_reserved_parameters_and_limiter_keys(spark):
    frame = spark.createDataFrame([({"platform": "tako", "a": "1", "streamKey": "k", "overlayType": "x"}, "1.2.3.4", "9.9.9.9"), ({}, "", "9.9.9.9"), (None, None, "")], "p map<string,string>, ip string, address string")
    got = frame.select(web.minus_reserved(F.col("p")).alias("p"), state.limiter_key(F.col("ip"), F.col("address")).alias("k")).collect()
    assert [(r.p, r.k) for r in got] == [({"a": "1"}, "1.2.3.4"), ({}, "9.9.9.9"), (None, "unknown")]
