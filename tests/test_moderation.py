"""Decisions over whole messages, and agreement of the two forms of each text step."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import evidence as E
from palisade.operators import matching, preparing, typo
from palisade.operators.decision import decide
from palisade.plans.moderate import check, check_frames, moderate

CASES = [
    ("user1", "situs hoki88 diblokir", "block"),
    ("Admin_Hoki88", "semangat bang", "block"),
    ("spam", "k a n t o r b o l a 9 9 wd lancar", "block"),
    ("spam", "s/u/l/t/a/n/j/p", "block"),
    ("spam", "S\nU\nL\nT\nA\nN\n3\n3", "block"),
    ("spam", "MÄHJÖNG77 scatter hitam", "block"),
    ("spam", "ｇａｃｏｒ８８ mantap", "block"),
    ("spam", "coba d1 H0K188 c41r", "block"),
    ("bot", "Buruan daftar sebelum promo habis", "block"),
    ("bot", "Cek sini bit.ly/gacor-hari-ini", "block"),
    ("anon", "Cek link di bio IG gue ya", "review"),
    ("anon", "Nunggu petir merah x1000 turun", "review"),
    ("player", "Gimana cara depo via pulsa?", "review"),
    ("sport", "Nonton sepakbola timnas nanti malam", "allow"),
    ("worker", "Ubah timeslot meeting ke jam 3 sore", "allow"),
    ("user", "Nyari slot parkir di mall susah banget", "allow"),
    ("user", "stop judol bahaya banget bro", "allow"),
    ("", "  ", "allow"),
    (None, None, "allow"),
]


def test_decisions(spark):
    frame = spark.createDataFrame([(i, d, m) for i, (d, m, _) in enumerate(CASES)], "i int, donator string, message string")
    got = {r.i: r for r in moderate(frame).collect()}
    wrong = [(CASES[i][:2], CASES[i][2], got[i].action, got[i].stage) for i in got if got[i].action != CASES[i][2]]
    assert not wrong
    assert got[len(CASES) - 1].stage == "empty" and got[len(CASES) - 1].reason == "empty input"
    assert got[16].stage == "anti-judol-context"


def test_classifier_joins_the_decision(spark):
    frame = spark.createDataFrame([(1, "user", "halo bang", 0.95), (2, "user", "stop judol bahaya", 0.95), (3, "user", "makasih", 0.02), (4, "u", "halo", float("nan")), (5, "u", "halo", 0.5), (6, "u", "halo", None)], "i int, donator string, message string, g double")
    plain = lambda c: F.array(F.lower(c))
    got = {r.i: r for r in decide(frame, plain("donator"), plain("message"), F.col("g")).collect()}
    assert (got[1].action, got[1].stage) == ("block", "classifier-confident") and "classifier=0.9500; classifierBoost=+5" in got[1].reason
    assert got[2].stage == "anti-judol-context" and got[3].score == -5 and got[3].action == "allow"
    assert got[4].reason == got[6].reason == "score=0" and got[5].reason == "score=0; classifier=0.5000"


@pytest.mark.parametrize("text", ["k a n t o r b o l a 9 9", "bo-co-ran po.la", "eth 77 hoki 50 HOKI 88", "p4st1 c41r g00gl3", "a! b@ $x |y", "satu dua"])
def test_column_and_batch_forms_agree(spark, text):
    frame = spark.createDataFrame([(text,)], "t string").select(T.normalize_text(F.col("t")).alias("b"), "t")
    row = frame.select("b", T.variants(F.col("b")).alias("v"), T.tighten(F.lower("t")).alias("tight"), T.fold_leet_smart(F.col("t")).alias("smart")).first()
    assert preparing.variants_of(tuple(row.b), None, False) == row.v
    assert typo.tightened(text.lower()) == row.tight
    assert preparing._smart(text) == row.smart


def test_evidence_forms_agree(spark):
    texts = [m for _, m, _ in CASES if m and m.strip()] + ["kantorbolla99 slot togel", "garuda hoki menang", "mabar slot vip dungeon"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array(F.lower("t")).alias("v"))
    lists = {k: matching.rule_hits(F.col("v"), r) for k, r in E.RULES.items()} | {k: matching.phrase_hits(F.col("v"), p) for k, p in E.PHRASES.items()}
    high = matching.brand_hits(T.all_tokens(F.col("v")), T.all_squeezed(F.col("v")))
    lists |= {"high": high, "near": matching.near_brand_hits(T.all_tokens(F.col("v")), T.all_squeezed(F.col("v")), high)}
    for row in frame.select("t", *[c.alias(n) for n, c in lists.items()]).collect():
        own = E.evidence_of((row.t.lower(),), True)
        for name in lists:
            got = [h.asDict() if hasattr(h, "asDict") else h for h in row[name]]
            assert got == own[name], (row.t, name)


def test_readings(spark):
    rows = [("aŦb", ["afb", "atb"]), ("", [""]), (None, [""]), ("wow!!!", ["wow!"]), ("heyyyyy", ["heyy"]), ("a​b", ["ab"]), ("ｆｕｌｌ ｗｉｄｔｈ", ["full width"]), ("𝓗𝓮𝓵𝓵𝓸", ["hello"]), ("héllo", ["hello"]), ("$lot", ["slot"]), ("a  \n b", ["a b"])]
    frame = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in frame.select(T.normalize_text(F.col("t"))).collect()] == [want for _, want in rows]


def test_check_and_frames(spark):
    frame = spark.createDataFrame([("saweria", "u", "daftar hoki88"), ("validate", "u", "halo")], "platform string, donator string, message string")
    got = {r.platform: r for r in check(frame).collect()}
    assert got["saweria"].response == '{"action":"block","replaceDonator":"***","replaceMessage":"***"}' and got["saweria"].marker.startswith("[block:")
    assert got["validate"].response == '{"action":"allow"}' and got["validate"].marker == "[allow]"
    killed = check(frame, killed=F.lit(True)).collect()
    assert {(r.action, r.marker) for r in killed} == {("allow", "[killed]")}
    raw = '{"type":"donation","data":[{"donator":"a","message":"halo","keep":1},{"donator":"b","message":"hoki88 gas","tts":"x"},{"donator":"c","message":"zeus88"}]}'
    frames = spark.createDataFrame([(1, "saweria", raw), (2, "saweria", '{"type":"other"}'), (3, "saweria", "junk")], "id int, platform string, raw string")
    out = {r.id: r for r in check_frames(frames).collect()}
    assert out[1].first_block == 1 and out[1].checked == 2 and '"keep":1' in out[1].delivered and '"tts":null' in out[1].delivered and "zeus" not in out[1].delivered
    assert out[2].delivered == '{"type":"other"}' and out[3].delivered == "junk" and out[3].first_block is None


def test_near_dictionary_words_decide_by_default(spark):
    rows = [("servar thailand", "review"), ("pazti menang", "review"), ("servar thailand pazti menang", "block"), ("halo bang", "allow")]
    frame = spark.createDataFrame([("saweria", "user", m) for m, _ in rows], "platform string, donator string, message string")
    for made in (moderate(frame), check(frame)):
        assert {r.message: r.action for r in made.collect()} == dict(rows)
    assert {r.action for r in moderate(frame, fuzzy=False).collect()} == {"allow"}
    raw = '{"type":"donation","data":[{"donator":"a","message":"halo"},{"donator":"b","message":"servar thailand pazti menang"}]}'
    frames = spark.createDataFrame([(1, "saweria", raw)], "id int, platform string, raw string")
    assert check_frames(frames).first().first_block == 1
