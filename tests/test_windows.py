"""Fixed windows of hits against one pass over each key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import state


def plain(rows, window):
    out, opened = {}, {}
    for key, t, o in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        until, n = opened.get(key, (-(1 << 62), 0))
        until, n = (t + window, 1) if t >= until else (until, n + 1)
        opened[key] = until, n
        out[key, o] = (t, n, until)
    return out


def test_random_keys(spark):
    rng = random.Random(3)
    for window in (7, 100):
        rows = []
        for key in ["a", "b", None, "dense", "sparse"]:
            now = rng.randrange(-5_000, 5_000)
            for _ in range(900):
                now += rng.choice({"dense": [0, 0, 1], "sparse": [window - 1, window, window + 1, 40 * window]}.get(key, [0, 1, 3, window, 20 * window]))
                rows.append((key, now, len(rows)))
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "k string, t long, o long")
        got = {(r["_key"], r["_order"]): (r["_t"], r["_n"], r["_until"]) for r in state.windows(frame, "k", "t", "o", window).collect()}
        assert got == plain(rows, window) and len(got) == len(rows)
    assert state.windows(frame.limit(0), "k", "t", "o", 7).count() == 0


def test_one_hot_key_is_many_tasks(spark):
    hot = spark.range(400_000).select(F.concat(F.lit("hot"), F.left(F.col("id").cast("string"), F.lit(0))).alias("k"), (F.col("id") * 5 + F.pmod(F.xxhash64("id"), F.lit(5))).alias("t"), F.col("id").alias("o"))
    # As for hits that are too many to be broadcast, and partitions too large to be joined together.
    plan = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {name: spark.conf.get(name) for name in plan}
    try:
        for name, value in plan.items():
            spark.conf.set(name, value)
        made = state.windows(hot, "k", "t", "o", 1_000).withColumn("part", F.spark_partition_id())
        found = made.groupBy("part").count().collect()
        assert len(found) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in found) < 0.6 * 400_000
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    times = np.array([r.t for r in hot.orderBy("o").select("t").collect()])
    starts, at = [], 0
    while at < len(times):
        starts.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + 1_000))
    assert sorted(r["s"] for r in made.select((F.col("_until") - 1_000).alias("s")).distinct().collect()) == starts


@pytest.mark.parametrize("window", [5, 50])
def test_leaps_equal_following_each_entry(window):
    rng = np.random.default_rng(window)
    for _ in range(200):
        times = np.sort(rng.integers(0, 16 * window, rng.integers(1, 60)))
        entry, end, hits, _ = state._leaps(times, np.array([0]), np.array([0]), window, 16 * window)
        for until in range(-1, window):
            at = int(np.searchsorted(times, until))
            place = int(np.searchsorted(entry, until))
            if at == len(times):
                assert place == len(entry)
                continue
            while (link := int(np.searchsorted(times, times[at] + window))) < len(times):
                at = link
            assert (end[place], hits[place]) == (times[at] + window, len(times) - at)


@pytest.mark.parametrize("name", ["rate_limit_fixed_window", "kill_switch_cached"])
def test_times_between_milliseconds_equal_sql(spark, tmp_path, name):
    """Milliseconds are rounded as SQL rounds them, and a flag changes in order of the whole time."""
    import datetime

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq
    from palisade.plans import catalogue

    rng, day = random.Random(5), datetime.datetime(2024, 1, 1)
    # Many in a millisecond or seconds apart, on both sides of half a millisecond; ids against the order of time; some before 1970.
    moments = [(day if i % 9 else datetime.datetime(1969, 12, 20)) + datetime.timedelta(seconds=rng.randrange(0, 90_000, 300), microseconds=rng.choice([0, 1, 400, 499, 500, 501, 999, 1_000, 1_499, 1_500])) for i in range(3_000)]
    kinds = [rng.choice(["view", "view", "error", "signup"]) for _ in moments]
    table = pa.table({"event_id": rng.sample(range(9_000), 3_000), "ts": pa.array(moments, pa.timestamp("us")), "user_id": [i % 7 for i in range(3_000)], "event_type": kinds})
    pq.write_table(table, tmp_path / "events.parquet")
    made = catalogue.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        wanted = sql.execute(f"SELECT {', '.join(made.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(wanted, key=repr)
