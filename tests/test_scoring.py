"""The scorer in its own process, and models of token ids."""

import math
import os
import time

import pandas as pd
import pytest

from palisade.operators import scoring


def children():
    """Processes whose parent is this one, and those that still wait to be taken leave of."""
    with open(f"/proc/{os.getpid()}/task/{os.getpid()}/children") as listed:
        return len(listed.read().split())


def test_hung_chunks_leave_no_process_and_no_thread():
    import threading

    def load():
        def model(texts):
            if texts[0] == "hang":
                time.sleep(60)
            if texts[0] == "die":
                os._exit(3)
            if texts[0] == "raise":
                raise ValueError("no")
            return [0.5] * len(texts)

        return model

    before, threads = children(), threading.active_count()
    apart = scoring._Apart(load, 10)
    for turn in range(1_000):
        assert scoring._scored(apart, ["hang"]) == [None]
        if not turn % 100:
            apart.limit = 5
            assert [scoring._scored(apart, [t]) for t in ("fine", "die", "fine", "raise", "fine")] == [[0.5], [None], [0.5], [None], [0.5]]
            apart.limit = 0.01
    apart.close()
    assert (children(), threading.active_count()) == (before, threads)


def test_a_model_that_does_not_load_fails_the_task(spark):
    def load():
        raise OSError("no such file")

    frame = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="does not load"):
        scoring.predict(frame, "t", load).collect()


def test_ids_are_cut_and_padded():
    seen = []

    def logits(rows):
        seen.append(rows)
        return [(0.0, float(sum(r))) for r in rows]

    model = scoring.sequence_model(lambda t: [ord(c) - 96 for c in t], logits, most=3)
    got = model(["a", "bcdefg", ""])
    assert seen == [[[1, 0, 0], [2, 3, 4], [0, 0, 0]]]
    assert got == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.exp(-9)), 0.5])
    assert model([]) == []


def test_long_texts_reach_the_network_cut(spark):
    def load():
        return scoring.sequence_model(lambda t: list(t.encode()), lambda rows: [(0.0, 1.0 if len(r) == scoring.fixed.MAX_TOKENS else -1.0) for r in rows])

    frame = spark.createDataFrame(pd.DataFrame({"t": ["x" * 5_000, "y" * 600]}))
    assert [r.label for r in scoring.predict(frame, "t", load).collect()] == [1, 1]
