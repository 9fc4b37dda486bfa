"""Turn repair against an exhaustive search over all edits."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from palisade.llm.conversations import damaged, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, turns): every sequence of edits, cheapest and then ASCII-least. rows: role, text, fault."""
    best = [(2 * len(rows), "D" * len(rows), [])]
    found = []

    def go(at, cost, audit, out):
        if cost > best[0][0] or not re.fullmatch(r"s?(ua)*u?", "".join(r[:1] for r, _ in out)):
            return
        if at == len(rows) and GRAMMAR.fullmatch("".join(r[:1] for r, _ in out)):
            found.append((cost, audit, list(out)))
            best[0] = min(best[0], found[-1][:2] + ([],))
        if audit[-2:] != "II":
            for role in ("user", "assistant"):
                go(at, cost + 5, audit + "I", [*out, (role, "")])
        if at < len(rows):
            role, text, fault = rows[at]
            go(at + 1, cost + 2, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go(at + 1, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(at + 1, cost + more + 1, audit + "R", [*out, (new, text)])

    go(0, 0, "", [])
    return min(found, key=lambda x: x[:2])


def plain(conversation):
    """The contract's row for one conversation of (turn, role, text) after damage, in order."""
    seen, rows = set(), []
    for turn, role, text in conversation:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, text, fault))
    turns = [t for t, _, _ in conversation if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for r, _, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = cheapest(rows)
    count = [sum(f == k for _, _, f in rows) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def harmed(rows):
    """(conv, turn, role, text) rows -> conversations after damage, sorted as repair sorts them."""
    out = {}
    for conv, turn, role, text in rows:
        c, t, r, x = (" " if v is None else str(v) for v in (conv, turn, role, text))
        harm = zlib.crc32(f"{c}:{t}".encode()) % 20
        own = out.setdefault(conv, [])
        x = "" if harm == 1 else x.translate({46: None, 33: None, 63: None}) if harm == 2 else x
        own += [(turn, "user" if harm == 4 else r, x)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    for own in out.values():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def held(spark, frame):
    return {r["conv_id"]: tuple(r)[1:] for r in repair(frame).collect()}


def test_random_conversations(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Hi.", "Why?", "And then", "", " \t", None, "Fin !\n", "é", "Hi."]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(roles), rng.choice(texts)))
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me.")]
    got = held(spark, damaged(spark.createDataFrame(rows, SCHEMA)).repartition(3))
    expected = {conv: plain(own) for conv, own in harmed(rows).items()}
    assert got == expected


def test_undamaged_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 4, "assistant", "Yes."), (2, 0, "assistant", "Alone."), (3, 0, "user", "no end"), (3, 1, "user", "no end")]
    got = held(spark, spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(False)).withColumn("fault", F.lit("another column")))
    assert got[1][:7] == (2, 0, 0, 0, 0, 0, "KKK")
    assert got[2][5:7] == (2, "D")
    assert got[3][:7] == (0, 0, 1, 1, 1, 4, "DD")


def test_a_long_conversation_spans_batches_and_an_emptied_one_stays(spark):
    texts = [(7, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(5_001)]
    frame = spark.createDataFrame(texts, SCHEMA).withColumn("gone", F.lit(False))
    only = spark.createDataFrame([(8, 1, "user", "")], SCHEMA).withColumn("gone", F.lit(True))
    got = held(spark, frame.unionByName(only))
    assert got[7][5:7] == (2, "D" + "K" * 5_000)
    assert got[7][7] == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in texts[1:]).encode()).hexdigest()
    assert got[8] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_very_long_text_and_empty_table(spark):
    long = "word " * 400_000 + "."
    frame = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "Fine.")], SCHEMA).withColumn("gone", F.lit(False))
    assert held(spark, frame)[1][7] == hashlib.sha256(f"user:{long}\nassistant:Fine.".encode()).hexdigest()
    assert repair(frame.limit(0)).collect() == []
