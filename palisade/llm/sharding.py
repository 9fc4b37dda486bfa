"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every key hashes to a position of the ring and first belongs to the arc's shard. A shard takes keys
until its quota is full; what overflows goes on clockwise to the next shard that has room. Quotas add up
to the number of rows (base quota or one more), so counts differ by at most one ("rows" law), and
only overflowing keys leave their place on the ring.

Nothing but counts of arcs (virtual nodes * shards, fixed by parameters) reaches the driver. Rows are
ranked inside (arc, cell) groups of bounded size; their place in the shard follows from prefix sums
over the counts, so no task ever holds a shard.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import literal_rows, settled

RING = 1 << 32
#: Rows that a ranking group should hold, and the most groups of one arc (bounds the broadcast below).
CELL_ROWS = 20_000
MAX_CELLS_PER_ARC = 512
#: Parts into which the rows of an overfull cell (one key repeated many times) are dealt.
HOT_PARTS = 256
#: Lists of up to so many groups (about 40 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_GROUPS = 200_000


def position(key: Column, salt: str) -> Column:
    """Place on the ring of a key, 0 to 2^32 - 1; null keys share one place."""
    return F.xxhash64(F.lit(salt), key.cast("string"), key.isNull()).bitwiseAND(F.lit(RING - 1))


def virtual_nodes(shards: int, per_shard: int) -> list[tuple[int, int]]:
    """(position, shard), sorted: where each shard's virtual nodes stand. Adding a shard moves none."""
    import xxhash

    points = {}
    for shard in range(shards):
        for replica in range(per_shard):
            at = xxhash.xxh64_intdigest(f"node/{shard}/{replica}") % RING
            while at in points:
                at = (at + 1) % RING
            points[at] = shard
    return sorted(points.items())


def quotas(rows: int, shards: int) -> list[int]:
    base, more = divmod(rows, shards)
    return [base + (shard < more) for shard in range(shards)]


def allot(counts: dict[int, int], nodes: list[tuple[int, int]], limits: list[int]) -> list[dict]:
    """Which ranks of each arc go to which shard: rows of arc, shard, lo, hi (rank range), base (slot of lo).

    Round r offers what is left of an arc to its r-th distinct shard clockwise, arcs in ring order.
    """
    shards, room = len(limits), list(limits)
    ways = []
    for at in range(len(nodes)):
        way: list[int] = []
        for step in range(len(nodes)):
            shard = nodes[(at + step) % len(nodes)][1]
            if shard not in way:
                way.append(shard)
                if len(way) == shards:
                    break
        ways.append(way)
    left, done, used, out = dict(counts), dict.fromkeys(counts, 0), [0] * shards, []
    for turn in range(shards):
        for arc in sorted(left):
            take = min(left[arc], room[ways[arc][turn]]) if turn < len(ways[arc]) else 0
            if take:
                shard = ways[arc][turn]
                out.append({"arc": arc, "shard": shard, "lo": done[arc], "hi": done[arc] + take, "base": used[shard]})
                done[arc] += take
                left[arc] -= take
                room[shard] -= take
                used[shard] += take
    return out


def ring_shards(docs: DataFrame, key: str = "doc_id", keep: list[Column] | None = None, shards: int = 8, per_shard: int = 64, salt: str = "ring") -> DataFrame:
    """Deal all rows of docs to shards 0 .. shards - 1.

    Returns the columns of `keep` (default: the key) and `shard` int, `slot` long: the row's place in
    its shard, gapless from 0. Null keys, repeated keys and repeated rows are all placed, each once;
    ties of a key are ordered by the kept columns and then arbitrarily. Rows of an overfull cell are numbered by the
    input partition they come from, so their slots (not the shards' sizes) may differ between runs. An empty table gives an
    empty result. Names in docs do not matter, as only `keep` and the key are read.
    """
    spark = docs.sparkSession
    keep = keep or [F.col(key)]
    nodes = virtual_nodes(shards, per_shard)
    narrow = docs.select(F.struct(*keep).alias("kept"), position(F.col(key), salt).alias("_at"))
    # The arc of a position ends at the next node clockwise; past the last node the ring closes.
    arc = _first_at_least(F.col("_at"), [at for at, _ in nodes])
    narrow = settled(narrow.withColumn("_arc", arc).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(HOT_PARTS)).cast("int")))
    rows = narrow.count()
    per_arc = rows / max(1, len(nodes))
    cells = int(min(MAX_CELLS_PER_ARC, max(1, per_arc // CELL_ROWS + 1)))
    cell = F.pmod(F.xxhash64(F.lit("cell"), "_at"), F.lit(cells)).cast("int")
    placed = narrow.withColumn("_cell", cell)
    counted = placed.groupBy("_arc", "_cell").count()
    hot = counted.where(F.col("count") > 8 * CELL_ROWS).select("_arc", "_cell", F.lit(True).alias("_hot"))
    placed = placed.join(F.broadcast(hot), ["_arc", "_cell"], "left").withColumn("_sub", F.when(F.col("_hot"), F.col("_part")).otherwise(0)).drop("_hot", "_part")
    # One row per arc and cell, and per part of hot cells: broadcast where they are few; else no group is larger than a cell.
    groups = placed.groupBy("_arc", "_cell", "_sub").count()
    before = Window.partitionBy("_arc").orderBy("_cell", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    groups = settled(groups.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))))
    arcs = {r["_arc"]: r["n"] for r in groups.groupBy("_arc").agg(F.sum("count").alias("n")).collect()}
    shares = allot(arcs, nodes, quotas(rows, shards))
    table = literal_rows(spark, shares, "arc int, shard int, lo long, hi long, base long").groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard", "base"))).alias("_shares"))
    # A group's rows are ranked alone; the arc's earlier groups shift the rank.
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc", "_cell", "_sub").orderBy("_at", "kept")).cast("long") - 1)
    sums = groups.drop("count")
    ranked = ranked.join(F.broadcast(sums) if sums.count() <= BROADCAST_GROUPS else sums, ["_arc", "_cell", "_sub"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.join(F.broadcast(table.withColumnRenamed("arc", "_arc")), "_arc")
    share = F.filter("_shares", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0]
    return ranked.withColumn("_share", share).select("kept.*", F.col("_share.shard").alias("shard"), (F.col("_share.base") + F.col("_rank") - F.col("_share.lo")).alias("slot"))


def _first_at_least(value: Column, sorted_points: list[int]) -> Column:
    """Index of the first point >= value, by binary search over literals; 0 past the last (the ring closes)."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo % len(sorted_points)).cast("int")
        mid = (lo + hi) // 2
        return F.when(value <= sorted_points[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(sorted_points))


def home_shard(at: int, nodes: list[tuple[int, int]]) -> int:
    """The shard of the first node at or after a position (plain Python, for tests and tools)."""
    points = [p for p, _ in nodes]
    index = bisect_right(points, at - 1)
    return nodes[index % len(nodes)][1]
