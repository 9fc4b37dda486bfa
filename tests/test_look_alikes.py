"""Look-alike tables: built from character sets, and used by normalisation."""

import random
import time

from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import scoring, typo
from palisade.plans.moderate import moderate
from palisade.sources.look_alikes import build_look_alikes, tables


def test_built_table_filters_gathers_and_orders(spark):
    rows = [(1, "A", "α"), (2, "b", "ß"), (3, "D", "ß"), (4, "B", "ß"), (5, "x", "x"), (6, "x", "y"), (7, "x", ""), (8, "x", None), (9, "xx", "ж"), (10, "1", "ж"), (11, "s", "☀"), (12, "K", "|<"), (13, "O", "⊙"), (14, None, "ж"), (15, "a", "😀")]
    built = build_look_alikes(spark.createDataFrame(rows, "i int, key string, glyph string"), ["i"])
    assert sorted(map(tuple, built.collect())) == [("|<", "K", "ligature"), ("ß", "BD", "several"), ("α", "A", "single"), ("⊙", "O", "single")]
    made = tables(built)
    assert made == {"look_alikes": ("α⊙", "AO"), "readings": ((0xDF, "BD"),), "ligatures": (("|<", "K"),)}
    read = spark.createDataFrame([("αß|<ß",), ("plain",), (None,)], "t string").select(T.normalize_text(F.col("t"), **made).alias("v"))
    assert [r.v for r in read.collect()] == [["abkb", "abkd", "adkb", "adkd"], ["plain"], [""]]
    assert build_look_alikes(spark.createDataFrame([], "i int, key string, glyph string"), ["i"]).count() == 0


def test_letters_of_many_scripts_read_as_latin_ones(spark):
    words = ["ᗷᗩᑎᗪᗩᖇ", "🅶🅰🅲🅾🆁", "🅣🅞🅣🅞", "ꓢꓡꓳꓔ", "₳₲₵", "ｇａｃｏｒ", "𝕘𝕒𝕔𝕠𝕣", "ᎷᎪX", "ѕӏот", "gäcör"]
    got = [r.v[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(T.normalize_text(F.col("t")).alias("v")).collect()]
    assert got[:8] == ["bandar", "gacor", "toto", "slot", "agc", "gacor", "gacor", "max"] and got[9] == "gacor"


def test_readings_of_three_letters_stop_at_the_limit(spark):
    frame = spark.createDataFrame([("x¤y¤",), ("¤" * 40,)], "t string")
    got = [r.v for r in frame.select(T.branches(F.col("t"), 9, ((0xA4, "PQR"),)).alias("v")).collect()]
    assert got[0] == [f"x{a}y{b}" for a in "PQR" for b in "PQR"]
    assert got[1] == [a + b + "P" * 38 for a in "PQR" for b in "PQR"]


def test_long_texts_with_one_such_letter_take_linear_time(spark):
    frame = spark.createDataFrame([("a" * 200_000 + "Ŧ" + "b" * 200_000,)], "t string")
    began = time.perf_counter()
    assert [len(v) for v in frame.select(T.branches(F.col("t")).alias("v")).first().v] == [400_001, 400_001]
    assert time.perf_counter() - began < 20


def test_a_late_scorer_gives_no_score(spark):
    def load():
        def model(texts):
            if "slow" in texts:
                time.sleep(3)
            return [0.9] * (len(texts) + ("odd" in texts))

        return model

    frame = spark.createDataFrame([("slow",), ("quick",), ("odd",)], "t string").coalesce(1)
    got = {r.t: r.gambling for r in scoring.predict(frame, "t", load, rows=1, limit_ms=500).collect()}
    assert got == {"slow": None, "quick": 0.9, "odd": None}


def test_dictionary_of_a_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Kata \n kata\nkedua\nab1\n\nnaïve\n")
    words = typo.known_words(typo.read_dictionary(spark, str(tmp_path / "words.txt")))
    assert words == ("kata", "kedua")
    assert typo.Matcher(words).match("kdeua")[0] in ("fuzzy", "unknown") and typo.Matcher(words).match("k4ta")[:2] == ("normalized", "kata")


def test_sequences_are_replaced_in_order(spark):
    rng = random.Random(6)
    pairs = T.ligatures()
    pieces = [a for a, _ in pairs] + [c for a, _ in pairs for c in a] + list("aZ9 .⃝")
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(400)] + ["plain", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold_ligatures(F.col("t"))).collect()]
    for text, own in zip(texts, got):
        for a, b in pairs if text else ():
            text = text.replace(a, b)
        assert own == text


def test_sequences_and_readings_reach_the_decision(spark):
    rows = [("flags", "\U0001f1ed \U0001f1f4 \U0001f1f0 \U0001f1ee 88"), ("marks", "h⃝o⃝k⃝i⃝88"), ("blocks", "s▙ ⬤ t g\U0001f170️⫷ or"), ("two readings", "sƖot gacor"), ("cyrillic", "рр дасор"), ("none", "\U0001f1ee\U0001f1e9 merdeka")]
    frame = spark.createDataFrame([(n, "u", m) for n, m in rows], "name string, donator string, message string")
    got = {r["name"]: r["action"] for r in moderate(frame).collect()}
    assert got["none"] == got["cyrillic"] == "allow" and {got[n] for n in ("flags", "marks", "blocks", "two readings")} == {"block"}


def test_stated_letters_outrank_names_and_shapes():
    table = dict(zip(*T.look_alikes()))
    assert [table[c] for c in "ßѵωЖ€𝚺𝛅øå"] == list("BVWXEEDOA")
    assert not {"é", "Ŧ", "\U0001f1e6", "⒜"} & set(table)
