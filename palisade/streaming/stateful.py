"""Streaming forms: keyed state in RocksDB, moderation of frames, the control flag, once-only delivery, audit lines."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palisade.functions import fixed_values as fixed
from palisade.operators import audit
from palisade.plans.moderate import check_frames, moderate

#: Rows of one frame that a keyed step hands out.
OUT_ROWS = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, evict: bool) -> DataFrame:
    """rows by key through a processor. Its state lies in RocksDB, on executors' disks, so keys may be many; the session keeps that provider.

    State that ages keeps a query busy: a run over what is there (availableNow) leaves eviction out.
    """
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if evict else "None")


class _Limiter(StatefulProcessor):
    """State of a key: the end of its open window and the hits in it, kept for `ttl_ms` after the last one."""

    def __init__(self, window_ms: int, most: int, ttl_ms: int | None) -> None:
        self.window_ms, self.most, self.ttl_ms = window_ms, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "until long, count long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, count = self.opened.get() if self.opened.exists() else (-1, 0)
        # Of a trigger only the times are held, which come in several batches and are put in order over all of them.
        times = np.sort(np.concatenate([batch["ts_ms"].to_numpy() for batch in rows]))
        at = 0
        while at < len(times):
            if until <= times[at]:
                until, count = int(times[at]) + self.window_ms, 0
            stop = min(at + OUT_ROWS, at + int(np.searchsorted(times[at:], until)))
            own = times[at:stop]
            counts = count + 1 + np.arange(len(own))
            late = counts > self.most
            wait = np.maximum(1, -(-(until - own) // 1000))
            yield pd.DataFrame({"key": key[0], "ts_ms": own, "count": counts.astype(np.int32), "limited": late, "retry_after": pd.Series(wait, dtype="Int32").where(late)})
            count, at = count + len(own), stop
        self.opened.update((until, count))

    def close(self) -> None:
        pass


def rate_limit_stream(hits: DataFrame, window_ms: int = fixed.RATE_WINDOW_MS, most: int = fixed.RATE_MAX, evict: bool = True) -> DataFrame:
    """hits (key string, ts_ms long) plus count, limited, retry_after.

    With evict, the state of keys that pause for two windows of processing time is dropped; see _keyed for when to leave it out.
    """
    return _keyed(hits, "key", _Limiter(window_ms, most, 2 * window_ms if evict else None), "key string, ts_ms long, count int, limited boolean, retry_after int", evict)


class _Armed(StatefulProcessor):
    """State of a session: whether a signal came since its last fetch, kept for `ttl_ms` after the last event."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.armed = handle.getValueState("armed", "armed boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        armed = bool(self.armed.get()[0]) if self.armed.exists() else False
        events = pd.concat([batch[["ts_ms", "kind"]] for batch in rows]).sort_values("ts_ms", kind="stable")
        signal, fetch = (events["kind"] == "signal").to_numpy(), (events["kind"] == "fetch").to_numpy()
        at = np.flatnonzero(fetch)
        # Signals up to each fetch, against those up to the fetch before.
        seen = np.cumsum(signal)[at] + armed
        inspected = seen > np.append(0, seen[:-1]) if len(at) else np.zeros(0, bool)
        times = events["ts_ms"].to_numpy()[at]
        for first in range(0, len(at), OUT_ROWS):
            yield pd.DataFrame({"session": key[0], "ts_ms": times[first : first + OUT_ROWS], "inspected": inspected[first : first + OUT_ROWS]})
        self.armed.update((bool(signal[at[-1] + 1 :].any()) if len(at) else armed or bool(signal.any()),))

    def close(self) -> None:
        pass


def arm_fire_stream(events: DataFrame, idle_ms: int = 24 * 3_600_000, evict: bool = True) -> DataFrame:
    """Fetches of events (session string, ts_ms long, kind 'signal' or 'fetch') plus inspected.

    With evict, the state of sessions that are silent for idle_ms of processing time is dropped; see _keyed for when to leave it out.
    """
    return _keyed(events, "session", _Armed(idle_ms if evict else None), "session string, ts_ms long, inspected boolean", evict)


def controlled(batch_of: Callable[[DataFrame, bool], None], control: Callable[[], DataFrame], ttl_ms: int = fixed.FLAG_TTL_MS, clock: Callable[[], float] = time.monotonic) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives batch_of each micro-batch and the control flag.

    control reads the flag's table (version, active), of which the largest version holds; a missing or empty table, or one that cannot be
    read, leaves the last flag known (at first off). It is read again for a batch only if the last look is ttl_ms ago or
    more: a flag that is flipped changes batches that begin later, never rows that are on their way.
    """
    seen = {"active": False, "until": float("-inf")}

    def step(batch: DataFrame, batch_id: int) -> None:
        if clock() >= seen["until"]:
            with suppress(AnalysisException):
                newest = control().agg(F.max_by("active", "version").alias("active")).first()
                seen["active"] = seen["active"] if newest["active"] is None else newest["active"]
            seen["until"] = clock() + ttl_ms / 1000
        batch_of(batch, seen["active"])

    return step


def once_only(checks: DataFrame, ts: str, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """checks of several listeners, each frame once: rows equal in the digest of `keys` count once within the delay, over all triggers."""
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys]), 256)
    return checks.withColumn("_digest", digest).withWatermark(ts, within).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def audit_batches(path: str, ts: str = "ts", line: str = "line", platform: str | None = "platform") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes audit lines, each micro-batch to folders of its own.

    A batch that is replayed after a failure replaces what it had written, so no line is doubled. `batch` and `dt` are partition columns.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        audit.write_audit(batch, f"{path}/batch={batch_id}", ts, line, platform, mode="overwrite")

    return step


def moderate_stream(events: DataFrame, **options: object) -> DataFrame:
    """The batch plan over a stream: it is narrow and keeps no state."""
    return moderate(events, **options)


def check_frames_stream(frames: DataFrame, **options: object) -> DataFrame:
    """Frames of a stream checked and rewritten as in batches: nothing is shuffled and no state is kept."""
    return check_frames(frames, **options)
