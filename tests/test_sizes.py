"""Work that grows with the tables: tasks by size, texts read once, few worker processes, small batches."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import evidence, matching, typo
from palisade.operators.preparing import variants
from palisade.plans.moderate import check_frames
from palisade.sources import events


def plan_of(df):
    return str(df._jdf.queryExecution().executedPlan())


def test_larger_tables_are_more_tasks(spark, tmp_path):
    """However the files lie: here one row group."""
    table = spark.range(600_000).select(F.xxhash64("id").alias("id")).coalesce(1)
    table.write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    dealt = events.into_tasks(read)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == -(-size // events.TASK_BYTES) > spark.sparkContext.defaultParallelism
    assert sum(sizes) == 600_000 and max(sizes) < 1.5 * min(sizes)


def test_tightening_makes_each_step_once(spark):
    """A step within a step that uses its text twice would be made twice, and the first one eight times."""
    made = spark.range(1).select(F.concat(F.lit("a b  c.d e_f_gh ab.cd-ef s/l/o/t x"), F.col("id").cast("string")).alias("t")).select(T.tighten(F.col("t")).alias("v"))
    assert plan_of(made).count("regexp_extract_all") == 3
    text = made.first()["v"]
    assert text == typo.tightened("a b  c.d e_f_gh ab.cd-ef s/l/o/t x0")


def test_readings_are_folded_once(spark):
    made = spark.range(1).select(F.col("id").cast("string").alias("t")).select(T.normalize_text(F.col("t")).alias("v"))
    assert plan_of(made).count(T.look_alikes()[0][:40]) == 2


def test_phrases_and_brands_by_one_pass(spark):
    rng = random.Random(7)
    every = [p for own in evidence.PHRASES.values() for p in own]
    brands = [b for b in matching.fixed.BRANDS if len(b) > 4]
    texts = [" ".join(rng.choices([*every, "kata", "x" + rng.choice(every), rng.choice(every) + "y", rng.choice(brands), rng.choice(brands)[1:], rng.choice(brands) + "zz"], k=4)) for _ in range(200)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.filter(F.array("t"), lambda v: v.isNotNull()).alias("v"))
    rows = rows.withColumns({"tokens": T.all_tokens(F.col("v")), "squeezed": T.all_squeezed(F.col("v"))})
    made = rows.withColumns({"p": evidence.phrase_lists(F.col("v")), "b": evidence.brand_lists(F.col("tokens"), F.col("squeezed"))})
    lists = [matching.phrase_hits(F.col("v"), p).alias(f"p_{k}") for k, p in evidence.PHRASES.items()]
    high = matching.brand_hits(F.col("tokens"), F.col("squeezed"))
    for r in made.select("p", "b", *lists, high.alias("high"), matching.near_brand_hits(F.col("tokens"), F.col("squeezed"), high).alias("near")).collect():
        assert all(r["p"][k] == r[f"p_{k}"] for k in evidence.PHRASES)
        assert (r["b"]["high"], r["b"]["near"]) == (r["high"], r["near"])


def test_queries_of_phrases_and_brands_use_it(spark):
    from palisade.plans import catalogue

    for name in ("phrase_hits", "brand_columns"):
        plan = plan_of(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.count("ArrowEvalPython") == 1 and "levenshtein" not in plan and "rlike" not in plan.lower()


def test_variants_and_evidence_share_a_worker(spark):
    rows = spark.createDataFrame([(["halo slot"],)], "b array<string>")
    plan = plan_of(rows.select(evidence.evidence(variants(F.col("b"), typo.EVERYDAY, True), True).alias("e")))
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("make", ["frames", "rules"])
def test_batches_of_whole_texts_are_small(spark, make):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        if make == "frames":
            check_frames(spark.createDataFrame([("tako", "{}")], "platform string, raw string"))
        else:
            rules = spark.createDataFrame([("a", "b", 1)], "id string, pattern string, weight int")
            evidence.rules_by_text(spark.createDataFrame([(1, "b")], "k int, text string"), rules, "k")
        assert int(spark.conf.get(name)) == events.BATCH_ROWS
    finally:
        spark.conf.set(name, held)


def test_nearest_words_equal_measuring_all():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(11)
    words = ["".join(rng.choices("abcd\u00e9\U0001F600", k=rng.randrange(1, 10))) for _ in range(300)]
    index = typo._Words(words)
    for _ in range(300):
        token = "".join(rng.choices("abcd\u00e9", k=rng.randrange(1, 10)))
        for most in (1, 2):
            near = {place for place, word in index.near(token, most) if typo.bounded_distance(token, word, most) is not None}
            assert near == {i for i, w in enumerate(words) if distance(token, w) <= most}
    for a, b in zip(words, words[1:]):
        assert typo.bounded_distance(a, b, 2) == (d if (d := distance(a, b)) <= 2 else None)


def test_gated_patterns_equal_plain_ones(spark):
    """Classes behind one comparison take out what they take out alone, and most of them stand behind one."""
    from palisade.functions import fixed_values as fixed

    rng = random.Random(13)
    some = [chr(c) for c in (9, 10, 0x20, 0x41, 0x5B, 0x5D, 0x7B, 0x7D, 0xA0, 0xAC, 0xAD, 0xAE, 0x2028, 0x200B, 0x2022, 0x24C1, 0x24C2, 0x2600, 0x3000, 0xFE00, 0xFE0F, 0x1F1E6, 0x1F300, 0x1F3FB, 0x1FAFF)]
    texts = spark.createDataFrame([("".join(rng.choices(some, k=12)),) for _ in range(400)], "t string")
    t = F.col("t")
    pairs = [
        (T.strip_invisible(t), F.regexp_replace(t, fixed.INVISIBLE, "")),
        (T.strip_ornaments(t), F.regexp_replace(t, fixed.ORNAMENTS, "")),
        (T.strip_emoji(t), F.regexp_replace(F.regexp_replace(t, fixed.EMOJI, ""), rf"(?:{fixed.PICTURES}|[\x{{FE00}}-\x{{FE0F}}])+", " ")),
        (T.squeeze_space(t), F.lower(T.js_trim(F.regexp_replace(t, f"{T.SPACE}+", " ")))),
    ]
    for made, wanted in pairs:
        assert texts.where(made != wanted).count() == 0
    assert "(?=[^" in str(T.strip_emoji(t)) and "(?=[^" in str(T.fold_ligatures(t))
