"""Batch forms of the stateful operators: fixed-window limiter, arm and fire, control flag."""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from palisade.functions import fixed_values as fixed


def limiter_key(ip: Column, address: Column) -> Column:
    return F.coalesce(F.nullif(ip, F.lit("")), F.nullif(address, F.lit("")), F.lit("unknown"))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a time, rounded to the nearest, halves away from zero."""
    micros = F.unix_micros(ts.cast("timestamp"))
    shifted = micros + F.when(micros < 0, -500).otherwise(500)
    return ((shifted - shifted % 1000) / 1000).cast("long")


#: Windows of a stretch of a key's time, which is one task's at a time.
STRETCH = 16


def _whole(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each run of rows that are equal in the first n columns): all rows in order, and no run is cut."""
    held: list[pa.RecordBatch] = []

    def last(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in range(n))

    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None and held and last(batch) == last(held[-1]):
            held.append(batch)  # all of it goes on with the open run
            continue
        rows = pa.Table.from_batches([*held, *([] if batch is None else [batch])]).combine_chunks() if held or batch is not None else None
        if rows is None:
            return
        codes = [np.array(rows.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1), np.int64) for c in range(n)]
        heads = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], 0)]))
        if batch is None:
            yield rows, heads
        elif len(heads) > 1:
            yield rows.slice(0, int(heads[-1])), heads[:-1]
            held = rows.slice(int(heads[-1])).to_batches()
        else:
            held.append(batch)


def _column(rows: pa.Table, c: int) -> np.ndarray:
    return np.array(rows.column(c).combine_chunks(), np.int64)


def _placed(times: np.ndarray, heads: np.ndarray, starts: np.ndarray, window_ms: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, group, end, link) of the hits of many stretches: a number that ascends over all, the stretch, where it ends, the first hit a window later."""
    ends = np.append(heads[1:], len(times))
    group = np.repeat(np.arange(len(heads)), ends - heads)
    place = times - starts[group] + group * (3 * span)
    return place, group, ends[group], np.minimum(np.searchsorted(place, place + window_ms), ends[group])


def _leaps(times: np.ndarray, heads: np.ndarray, starts: np.ndarray, window_ms: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, end, hits, group): where a window of a stretch may be the first to begin, when the last one then ends and how many hits it holds.

    Each hit links to the first one a window later; all possible first hits of all stretches follow these links at once, and meet
    soon. Of entries of a stretch with the same outcome the last is kept.
    """
    place, group, end, link = _placed(times, heads, starts, window_ms, span)
    # Hits of a stretch's first window, and the first one after it.
    early = (place - group * (3 * span) < window_ms) | (np.arange(len(times)) == np.searchsorted(place, group * (3 * span) + window_ms))
    first = np.flatnonzero(early & np.append(True, place[1:] != place[:-1])[: len(times)])
    at, of = first, np.arange(len(first))
    while (on := link[at] < end[at]).any():
        at, back = np.unique(np.where(on, link[np.minimum(at, len(times) - 1)], at), return_inverse=True)
        of = back[of]
    last = at[of]
    kept = np.append(last[1:] != last[:-1], True)[: len(last)]
    first, last = first[kept], last[kept]
    return times[first], times[last] + window_ms, end[last] - last, group[first]


def windows(hits: DataFrame, key: str, ts_ms: str, order: str, window_ms: int) -> DataFrame:
    """_key, _t, _order of hits with _n, their number in their window, and _until, its end.

    Hits without a time are left out. A key's window begins at its first hit after the last one ended, so where it begins hangs on all hits before. Time is cut in
    stretches of STRETCH windows, and those of one key are dealt over tasks like those of many. A stretch first tells, for each hit that
    may be the first to open a window there, when the last window ends (links from hit to hit, followed by all at once). These
    short lists are then gone through in order of time by key, and each stretch is numbered from what was open when it began.
    """
    span = window_ms * STRETCH
    cut = hits.select(F.col(key).alias("_key"), F.col(ts_ms).cast("long").alias("_t"), F.col(order).alias("_order"))
    cut = cut.withColumn("_start", F.col("_t") - F.pmod("_t", F.lit(span)))
    ordered = cut.select("_key", "_start", "_t", "_order").repartition("_key", "_start").sortWithinPartitions("_key", "_start", "_t", "_order")
    kind = cut.schema["_key"].dataType

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, heads in _whole(batches, 2):
            *lists, group = _leaps(_column(rows, 2), heads, _column(rows, 1)[heads], window_ms, span)
            ends = pa.array(np.searchsorted(group, np.arange(len(heads) + 1)).astype(np.int32))
            named = [rows.column(c).combine_chunks().take(pa.array(heads)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*named, *[pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in lists]], ["_key", "_start", "_entry", "_end", "_hits"])

    lists = [StructField(n, ArrayType(LongType())) for n in ("_entry", "_end", "_hits")]
    leaps = ordered.mapInArrow(told, StructType([StructField("_key", kind), StructField("_start", LongType()), *lists]))

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until, held = None, -(1 << 62), 0
        for batch in batches:
            untils, helds = [], []
            borders = np.cumsum(np.append(0, np.array(batch.column(2).value_lengths(), np.int64))).tolist()
            entry, end, count = (batch.column(c).flatten().to_pylist() for c in (2, 3, 4))
            for row, key in enumerate(batch.column(0).to_pylist()):
                if (key,) != now:
                    now, until, held = (key,), -(1 << 62), 0
                untils.append(until)
                helds.append(held)
                at = bisect_left(entry, until, borders[row], borders[row + 1])
                # With no window begun here, the open one has ended before the next stretch.
                until, held = (end[at], count[at]) if at < borders[row + 1] else (until, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(untils, pa.int64()), pa.array(helds, pa.int64())], ["_k", "_s", "_open", "_held"])

    opened = leaps.repartition("_key").sortWithinPartitions("_key", "_start").mapInArrow(carried, StructType([StructField("_k", kind), *[StructField(n, LongType()) for n in ("_s", "_open", "_held")]]))
    joined = ordered.join(opened, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_start") == F.col("_s")))
    joined = joined.select("_key", "_start", "_t", "_order", "_open", "_held").sortWithinPartitions("_key", "_start", "_t", "_order")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, heads in _whole(batches, 2):
            times, starts = _column(rows, 2), _column(rows, 1)[heads]
            opened, held = _column(rows, 4), _column(rows, 5)
            place, group, end, link = _placed(times, heads, starts, window_ms, span)
            begun = np.zeros(len(times), bool)
            at = np.searchsorted(place, np.arange(len(heads)) * (3 * span) + np.clip(opened[heads] - starts, 0, 2 * span))
            at = at[at < np.append(heads[1:], len(times))]
            while len(at):
                begun[at] = True
                at = link[at][link[at] < end[at]]
            turn = np.arange(len(times))
            # The hit that opened each one's window; none, where that was before the stretch.
            own = np.maximum.accumulate(np.where(begun, turn, -1))
            here = own >= heads[group]
            counts = np.where(here, turn - own + 1, held + turn - heads[group] + 1)
            ends = np.where(here, times[own] + window_ms, opened)
            yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks() for c in (0, 2, 3)], pa.array(counts), pa.array(ends)], ["_key", "_t", "_order", "_n", "_until"])

    schema = StructType([cut.schema["_key"], cut.schema["_t"], cut.schema["_order"], StructField("_n", LongType()), StructField("_until", LongType())])
    return joined.mapInArrow(numbered, schema)


def rate_limit(hits: DataFrame, key: str, ts_ms: str, order: str, window_ms: int = fixed.RATE_WINDOW_MS, most: int = fixed.RATE_MAX) -> DataFrame:
    """hits (key, ts_ms, order) plus count, limited, retry_after (seconds, null unless limited). Refused hits count too."""
    folded = windows(hits, key, ts_ms, order, window_ms)
    limited = F.col("_n") > most
    wait = F.greatest(F.lit(1), F.ceil((F.col("_until") - F.col("_t")) / 1000)).cast("int")
    return folded.select(F.col("_key").alias(key), F.col("_order").alias(order), F.col("_t").alias(ts_ms), F.col("_n").cast("int").alias("count"), limited.alias("limited"), F.when(limited, wait).alias("retry_after"))


def arm_fire(events: DataFrame, session: str, order: list[str], signal: Column, fetch: Column) -> DataFrame:
    """The fetches of each session plus `inspected`: whether a signal came since the fetch before."""
    own = Window.partitionBy(session).orderBy(*order)
    marked = events.withColumn("_signals", F.sum(signal.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    fetches = marked.where(fetch)
    before = F.coalesce(F.lag("_signals").over(own), F.lit(0))
    return fetches.withColumn("inspected", F.col("_signals") > before).drop("_signals")


def flag_as_of(events: DataFrame, order: list[str], on: Column, off: Column, part: list[str] | None = None, chunks: int = 256) -> DataFrame:
    """events plus `active`: the control flag's last state at each row. Parts (such as days) are ordered alone.

    Without parts one flag holds for all rows. They are then cut into chunks at quantiles of the first order column (a
    number, date or time); each chunk is ordered alone, and begins with the last state of the chunks before it.
    """
    state = F.when(on, True).when(off, False)
    if part:
        own = Window.partitionBy(*part).orderBy(*order)
        return events.withColumn("active", F.coalesce(F.last(state, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    # At most `chunks` boundaries; a row's chunk is the number of boundaries before it, null values first.
    borders = events.select(F.array_distinct(F.coalesce(F.percentile_approx(order[0], shares, 10_000), F.array().cast(f"array<{events.schema[order[0]].dataType.simpleString()}>"))).alias("_borders"))
    marked = events.crossJoin(F.broadcast(borders)).withColumn("_chunk", F.size(F.filter("_borders", lambda b: b < F.col(order[0])))).drop("_borders")
    marked = marked.withColumn("_state", state)
    own = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = marked.where(F.col("_state").isNotNull()).groupBy("_chunk").agg(F.max_by("_state", F.struct(*order)).alias("_end"))
    every = events.sparkSession.range(chunks + 1).select(F.col("id").cast("int").alias("_chunk")).join(ends, "_chunk", "left")
    carried = every.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    joined = marked.withColumn("_own", F.last("_state", ignorenulls=True).over(own)).join(F.broadcast(carried), "_chunk")
    return joined.select(*events.columns, F.coalesce("_own", "_carried", F.lit(False)).alias("active"))


def cached_flag(events: DataFrame, key: str, ts_ms: str, order: str, on: Column, off: Column, check: Column, ttl_ms: int = fixed.FLAG_TTL_MS, at: list[str] | None = None) -> DataFrame:
    """The checks of events plus `active`: the flag as a process sees it that looks at it at most every ttl_ms.

    A check looks if the last look is ttl_ms ago or more, else it takes what was seen then. Keys are processes (or other parts). `at` orders the
    flag's changes where that is finer than milliseconds.
    """
    known = flag_as_of(events, at or [ts_ms, order], on, off, [key]).where(check)
    opened = windows(known, key, ts_ms, order, ttl_ms).select(F.col("_key"), F.col("_order"), F.col("_until"))
    both = known.join(opened, known[key].eqNullSafe(F.col("_key")) & (known[order] == F.col("_order")))
    own = Window.partitionBy(key, "_until").orderBy(ts_ms, order)
    return both.withColumn("active", F.first("active").over(own)).drop("_key", "_order", "_until")
