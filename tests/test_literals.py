"""Literals that patterns cannot do without, and the automata made of them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.operators import evidence as E
from palisade.operators import matching
from palisade.operators.literals import Gate, needed_literals


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("rtp", {"rtp"}),
        (r"\bcash(?:back)?\b", {"cash", "cashback"}),
        (r"(?:ab|cd)+x", {"ab", "cd"}),
        (r"a?b*c*", None),
        (r"\d{2,}[a-z]+", None),
        (r"(?!no)go|stay", {"go", "stay"}),
        (r"[xy]z\w*long", {"long"}),
        (r"AbC", {"abc"}),
        (r"(?:|q)\d", None),
    ],
)
def test_needed_literals(pattern, literals):
    assert needed_literals(pattern) == (None if literals is None else frozenset(literals))


def spelled(rng, node):
    """Some text of a pattern's parse tree."""
    out = ""
    for code, value in node:
        name = str(code)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            kind, arg = rng.choice([v for v in value if str(v[0]) != "NEGATE"])
            out += {"LITERAL": lambda a: chr(a), "RANGE": lambda a: chr(rng.randint(*a)), "CATEGORY": lambda a: "7" if "DIGIT" in str(a) and "NOT" not in str(a) else " "}[str(kind)](arg)
        elif name == "BRANCH":
            out += spelled(rng, rng.choice(value[1]))
        elif name == "SUBPATTERN":
            out += spelled(rng, value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))):
                out += spelled(rng, value[2])
        elif name in ("ANY", "NOT_LITERAL"):
            out += "q"
    return out


def test_every_text_of_a_rule_passes_the_gate():
    rng = random.Random(1)
    rules = [(n, p.replace("$", r"\Z")) for rows in E.RULES.values() for n, p, _ in rows]
    gate = Gate(needed_literals(p) for _, p in rules)
    hits = 0
    for number, (_, pattern) in enumerate(rules):
        for _ in range(60):
            text = " ".join(["halo", spelled(rng, re._parser.parse(pattern)), "kawan"][0 if "^" not in pattern else 1 :][: 3 if "^" not in pattern else 1])
            text = text.upper() if rng.random() < 0.3 else text
            matching_rules = {i for i, (_, p) in enumerate(rules) if re.search(p, text, re.ASCII | re.IGNORECASE)}
            assert matching_rules <= gate.worth(text)
            hits += number in matching_rules
    assert hits > 40 * len(rules) and len(gate.always) <= 2


def test_brand_lists_equal_the_column_forms(spark):
    rng = random.Random(3)

    def worn(brand):
        letters = list(brand)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], ["x"], [letters[at], "q"]])
        return "".join(letters)

    rows = []
    for _ in range(300):
        words = [worn(rng.choice(fixed.BRANDS)) if rng.random() < 0.5 else rng.choice(["halo", "kata", "bola88x", ""]) for _ in range(rng.randrange(6))]
        rows.append((words, ["".join(words)] if words else []))
    rows += [([], []), (None, None), (["a" * 4_096], ["ab" * 2_048 + "kantorbola"])]
    frame = spark.createDataFrame(rows, "tokens array<string>, squeezed array<string>")
    t, s = F.coalesce("tokens", F.array().cast("array<string>")), F.coalesce("squeezed", F.array().cast("array<string>"))
    exact = matching.brand_hits(t, s)
    got = frame.select(E.brand_lists(F.col("tokens"), F.col("squeezed")).alias("b"), exact.alias("high"), matching.near_brand_hits(t, s, exact).alias("near")).collect()
    assert all((r.b.high, r.b.near) == (r.high, r.near) for r in got) and sum(len(r.near) for r in got) > 20


def test_rules_of_a_table_equal_trying_each(spark):
    rules = [(n, p.replace("$", r"\Z"), w) for rows in E.RULES.values() for n, p, w in rows] + [("any", "[0-9]x", 2)]
    texts = ["situs gacor 88 hari ini", "RTP live 98%", "7X", "halo", "", None, "klik link di bio, wd cepat"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = sorted(tuple(r) for r in E.rules_by_text(frame, spark.createDataFrame(rules, "id string, pattern string, weight int"), "k").collect())
    want = sorted((i, n, w) for i, t in enumerate(texts) for n, p, w in rules if t and re.search(p, t, re.ASCII | re.IGNORECASE))
    assert got == want and len(got) > 5
    with pytest.raises(ValueError, match="rule table"):
        E.rules_by_text(frame, spark.range(E.MOST_RULES + 1).selectExpr("id", "'a' as pattern", "1 as weight"), "k")
