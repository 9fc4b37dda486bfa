import datetime
import json
import random
import time

from pyspark.sql import functions as F

from palisade.operators import audit, state
from palisade.operators.scoring import predict
from palisade.plans.moderate import check_frames
from palisade.sources.events import read_requests
from palisade.streaming.stateful import arm_fire_stream, audit_batches, check_frames_stream, controlled, moderate_stream, once_only, rate_limit_stream


def drained(stream, name, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name).collect()


def test_limiter_batch_equals_stream(spark, tmp_path):
    rows = [(k, t) for k in ("a", "b") for t in (0, 10, 20, 990, 1000, 1001, 2500, 2600, 2700, 2800)]
    frame = spark.createDataFrame(rows, "key string, ts_ms long")
    frame.write.parquet(str(tmp_path / "hits"))
    batch = state.rate_limit(frame.withColumn("o", F.lit(1)), "key", "ts_ms", "o", 1000, 3)
    want = sorted((r.key, r.ts_ms, r["count"], r.limited, r.retry_after) for r in batch.collect())
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "hits"))
    got = sorted((r.key, r.ts_ms, r["count"], r.limited, r.retry_after) for r in drained(rate_limit_stream(stream, 1000, 3, evict=False), "limited", spark))
    assert got == want
    assert [w[2] for w in want if w[0] == "a"] == [1, 2, 3, 4, 1, 2, 1, 2, 3, 4]
    assert [w for w in want if w[3]] == [("a", 990, 4, True, 1), ("a", 2800, 4, True, 1), ("b", 990, 4, True, 1), ("b", 2800, 4, True, 1)]


def test_arm_fire_batch_equals_stream(spark, tmp_path):
    rows = [("s", 1, "fetch"), ("s", 2, "signal"), ("s", 3, "signal"), ("s", 4, "fetch"), ("s", 5, "fetch"), ("t", 1, "signal"), ("t", 9, "fetch")]
    frame = spark.createDataFrame(rows, "session string, ts_ms long, kind string")
    frame.write.parquet(str(tmp_path / "events"))
    want = sorted((r.session, r.ts_ms, r.inspected) for r in state.arm_fire(frame, "session", ["ts_ms"], F.col("kind") == "signal", F.col("kind") == "fetch").collect())
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "events"))
    assert sorted((r.session, r.ts_ms, r.inspected) for r in drained(arm_fire_stream(stream, evict=False), "fired", spark)) == want
    assert want == [("s", 1, False), ("s", 4, True), ("s", 5, False), ("t", 9, True)]


def test_requests_stream_through_the_decision(spark, tmp_path):
    bodies = [{"platform": "tako", "donator": "x", "message": "hoki88", "amount": 5, "currency": "IDR"}, {"platform": 3, "donator": None, "message": ["a"], "amount": "7"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, bodies), "no json"]))
    rows = read_requests(spark, str(tmp_path / "in")).collect()
    assert [tuple(r) for r in rows] == [("tako", "x", "hoki88", "IDR", 5.0), ("", "", "", "", None), ("", "", "", "", None)]
    got = drained(moderate_stream(read_requests(spark, str(tmp_path / "in"), streaming=True)), "decided", spark)
    assert sorted((r.message, r.action) for r in got) == [("", "allow"), ("", "allow"), ("hoki88", "block")]


def fed(spark, rows, schema, path, make, pause=0, made=None):
    """What a query makes of one file of rows after another, in a run of its own each, with one checkpoint.

    made: how many rows there are after each run, for queries that do not end by themselves; pause: seconds between runs.
    """
    (path / "in").mkdir()
    out = []
    for turn, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / "staged" / str(turn)))
        for file in sorted((path / "staged" / str(turn)).glob("*.parquet")):
            file.rename(path / "in" / f"{turn}-{file.name}")
        time.sleep(pause if turn else 0)
        stream = make(spark.readStream.schema(schema).parquet(str(path / "in")))
        writer = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state"))
        query = (writer.trigger(processingTime="200 milliseconds") if made else writer.trigger(availableNow=True)).start()
        try:
            until = time.monotonic() + 60
            while query.isActive and time.monotonic() < until and not (made and (path / "out" / "_spark_metadata").exists() and spark.read.schema(stream.schema).parquet(str(path / "out")).count() >= made[turn]):
                time.sleep(0.3)
        finally:
            query.stop()
        assert query.exception() is None and time.monotonic() < until
        out.append(sorted(map(tuple, spark.read.schema(stream.schema).parquet(str(path / "out")).collect()), key=lambda r: [(v is not None, v) for v in r]))
    return out


def test_state_lasts_from_run_to_run_and_is_evicted(spark, tmp_path):
    parts = [[("a", 0), ("a", 10), ("b", 5)], [("a", 20), ("b", 5_000)]]
    (tmp_path / "kept").mkdir()
    (tmp_path / "gone").mkdir()
    kept = fed(spark, parts, "key string, ts_ms long", tmp_path / "kept", lambda s: rate_limit_stream(s, 1_000, 2, evict=False))
    assert kept[1] == [("a", 0, 1, False, None), ("a", 10, 2, False, None), ("a", 20, 3, True, 1), ("b", 5, 1, False, None), ("b", 5_000, 1, False, None)]
    gone = fed(spark, parts, "key string, ts_ms long", tmp_path / "gone", lambda s: rate_limit_stream(s, 1_000, 2, evict=True), 2.5, (3, 5))
    assert ("a", 20, 1, False, None) in gone[1]


def test_armed_sessions_last_and_are_evicted(spark, tmp_path):
    parts = [[("s", 1, "fetch"), ("s", 2, "signal")], [("s", 3, "fetch"), ("s", 4, "fetch")]]
    schema = "session string, ts_ms long, kind string"
    (tmp_path / "kept").mkdir()
    (tmp_path / "gone").mkdir()
    assert fed(spark, parts, schema, tmp_path / "kept", lambda s: arm_fire_stream(s, evict=False))[1] == [("s", 1, False), ("s", 3, True), ("s", 4, False)]
    assert fed(spark, parts, schema, tmp_path / "gone", lambda s: arm_fire_stream(s, 500), 1, (1, 3))[1] == [("s", 1, False), ("s", 3, False), ("s", 4, False)]


def test_doubled_frames_of_two_listeners_count_once_over_triggers(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1, 12)
    parts = [[(now, "f1", 1), (now, "f1", 2), (now, "f2", 1), (now, None, 1)], [(now, "f2", 2), (now, "f3", 1), (now, None, 2)]]
    made = fed(spark, parts, "ts timestamp, frame string, listener int", tmp_path, lambda s: once_only(s, "ts", ["frame"]).select("frame"))
    assert sorted(str(r[0]) for r in made[0]) == ["None", "f1", "f2"] and sorted(str(r[0]) for r in made[1]) == ["None", "f1", "f2", "f3"]


def test_a_flag_flipped_mid_stream_changes_later_batches_only(spark, tmp_path):
    now, seen, path = [0.0], [], str(tmp_path / "control")
    step = controlled(lambda batch, active: seen.append(active), lambda: spark.read.schema("version long, active boolean").parquet(path), 2_000, lambda: now[0])
    batch = spark.range(1)
    step(batch, 0)  # there is no table yet
    spark.createDataFrame([(1, True)], "version long, active boolean").write.mode("append").parquet(path)
    step(batch, 1)  # looked less than two seconds ago
    now[0] = 2.0
    step(batch, 2)
    spark.createDataFrame([(2, False)], "version long, active boolean").write.mode("append").parquet(path)
    now[0] = 3.9
    step(batch, 3)
    now[0] = 4.0
    step(batch, 4)
    assert seen == [False, False, True, True, False]


def test_a_replayed_batch_doubles_no_line(spark, tmp_path):
    lines = spark.createDataFrame([("tako", "2024-01-02 03:04:05", "a"), ("validate", "2024-01-02 03:04:05", "b"), ("tako", "2024-01-03 03:04:05", "c")], "platform string, ts string, line string").withColumn("ts", F.to_timestamp("ts"))
    step = audit_batches(str(tmp_path / "audit"))
    for batch_id in (0, 1, 1, 0):
        step(lines, batch_id)
    got = spark.read.text(str(tmp_path / "audit"))
    assert sorted((r.value, r.batch, str(r.dt)) for r in got.collect()) == [("a", 0, "2024-01-02"), ("a", 1, "2024-01-02"), ("c", 0, "2024-01-03"), ("c", 1, "2024-01-03")]


def frames_of(rng, n):
    rows = []
    for i in range(n):
        items = [{"donator": "a", "message": rng.choice(["halo", "halo", "gas hoki88", "kata"]), "amount": 1} for _ in range(rng.choice([0, 1, 2, 7, 40]))]
        raw = rng.choice([json.dumps({"type": "donation", "data": items}), json.dumps({"type": "donation", "data": items}), json.dumps({"type": "other"}), "{broken", None])
        rows.append((i, "saweria", raw, items if raw and raw.startswith('{"type": "donation"') else None))
    return rows


def test_frames_are_checked_in_place_in_batches_and_streams(spark, tmp_path):
    rows = frames_of(random.Random(9), 300)
    frame = spark.createDataFrame([r[:3] for r in rows], "flag long, platform string, raw string")
    frame.repartition(3).write.parquet(str(tmp_path / "frames"))
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # frames run over the borders of batches
    try:
        made = check_frames(spark.read.parquet(str(tmp_path / "frames")))
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        batch = {r.flag: r for r in made.collect()}
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "frames"))
        streamed = {r.flag: r for r in drained(check_frames_stream(stream), "frames", spark)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert batch == streamed and len(batch) == len(rows)
    for i, _, raw, items in rows:
        blocked = [k for k, item in enumerate(items or []) if "hoki88" in item["message"]]
        own = batch[i]
        assert own.first_block == (blocked[0] if blocked else None) and own.checked == (blocked[0] + 1 if blocked else len(items or []))
        if blocked:
            assert all(d["message"] == "***" for d in json.loads(own.delivered)["data"])
        else:
            assert own.delivered == raw
    assert sum(r.first_block is not None for r in batch.values()) > 50


def test_audit_sink_and_batch_prediction(spark, tmp_path):
    rows = spark.createDataFrame([("tako", "2024-01-02 03:04:05", "a"), ("validate", "2024-01-02 03:04:05", "b")], "platform string, ts string, line string").withColumn("ts", F.to_timestamp("ts"))
    audit.write_audit(rows, str(tmp_path / "audit"))
    assert [tuple(map(str, r)) for r in spark.read.text(str(tmp_path / "audit")).collect()] == [("a", "2024-01-02")]

    def load():
        def model(texts):
            if "boom" in texts:
                raise RuntimeError("broken")
            return [0.9 if "x" in t else 0.5 for t in texts]

        return model

    frame = spark.createDataFrame([("x",), ("",), ("boom",)], "t string").coalesce(1)
    got = {r.t: (r.label, r.gambling) for r in predict(frame, "t", load, rows=1).collect()}
    assert got == {"x": (1, 0.9), "": (0, 0.5), "boom": (None, None)}


def test_limiter_equals_a_plain_walk_over_batches(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.randrange(40_000), i) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "key string, ts_ms long, o long")
    want, state_of = {}, {}
    for key, t, o in sorted(rows, key=lambda r: (r[1], r[2])):
        until, n = state_of.get(key, (-1, 0))
        until, n = (t + 100, 1) if until <= t else (until, n + 1)
        state_of[key] = until, n
        want[o] = (key, t, n, n > 3, max(1, -(-(until - t) // 1000)) if n > 3 else None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.o: (r.key, r.ts_ms, r["count"], r.limited, r.retry_after) for r in state.rate_limit(frame, "key", "ts_ms", "o", 100, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_one_flag_for_all_rows_is_carried_over_chunks(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(50)]), i, rng.choice(["on", "off", "x", "x", "x", None])) for i in range(400)]
    frame = spark.createDataFrame(rows, "t int, i long, kind string")
    active, want = False, {}
    for t, i, kind in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        active = True if kind == "on" else False if kind == "off" else active
        want[i] = active
    for chunks in (2, 7, 256):
        made = state.flag_as_of(frame, ["t", "i"], F.col("kind") == "on", F.col("kind") == "off", chunks=chunks)
        assert {r.i: r.active for r in made.collect()} == want and made.columns == [*frame.columns, "active"]
    assert state.flag_as_of(frame.limit(0), ["t", "i"], F.col("kind") == "on", F.col("kind") == "off").count() == 0
