"""Exact Jaccard self-join of word-shingle sets by prefix filtering and tries.

1. Equal sets are one class, so copies cost nothing more.
2. All sets share one global order: shingles by hash, the most frequent ones (a bounded list) last. Two sets
   that are similar enough share a shingle of their prefixes. Classes that meet in a prefix shingle are
   compared by lossless bounds only: sizes, and the parity sketch, whose differing bits never outnumber the
   differing shingles. What survives forms blocks, by connected components; no true link is lost.
3. A block's sets are stored in a trie in one global order (frequent first). Probes walk it together and share
   the overlap of each path; a subtree is left when the lengths that remain cannot bring any probe to the
   threshold. Overlaps at the leaves are exact.
Blocks and prefix groups that grow large are split in tiles of bounded size that each see every pair once. A class
is known by a 128-bit digest of its set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from palisade.llm.common import byte_slices, frugal, lean, settled
from palisade.llm.components import components
from palisade.llm.shingles import mixed, shingles

#: Shingles that are ordered last because they are frequent, at most, and documents that make one frequent.
FREQUENT, FREQUENT_FROM = 200_000, 24
#: Classes of one tile of a prefix shingle; shingles of one tile of a block that is joined; cells of the table of probes
#: that walk a trie together.
GROUP_TILE, BLOCK_TILE, PROBE_CELLS = 2_048, 600_000, 1 << 25
#: Runs of classes that a worker remembers, so as not to look at the same one again.
SEEN_RUNS = 100_000
#: Lists of up to so many ids (8 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of a sketch, least and most.
SKETCH_BITS = (64, 8_192)


def prefix_length(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Smallest shingles of a set of n of which a set that is similar enough must have one."""
    return n - -(-n * percent // 100) + 1


def sketch_of(values: np.ndarray) -> bytes:
    """Parities of the set's shingles dealt over a power of two of bits, about as many as shingles."""
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 1 << (max(1, len(values)) - 1).bit_length()))
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: tuple[int, int, int], b: tuple[int, int, int], percent: int) -> bool:
    """Whether (size, sketch bits, sketch) of two sets allow the threshold. Never false for a true link."""
    (n, wide, x), (m, width, y) = a, b
    if 100 * min(n, m) < percent * max(n, m):
        return False
    # A sketch folds to half its bits by XOR, as the lower bits of the hash choose the place.
    while wide > width:
        wide //= 2
        x = (x >> wide) ^ (x & ((1 << wide) - 1))
    while width > wide:
        width //= 2
        y = (y >> width) ^ (y & ((1 << width) - 1))
    # difference <= (1 - t) * union and union = (n + m + difference) / 2.
    return (100 + percent) * (x ^ y).bit_count() <= (100 - percent) * (n + m)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _digest(values: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    own = np.append(values, np.uint64(len(values)))
    a = mixed(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).sum(dtype=np.uint64, keepdims=True)
    b = np.bitwise_xor.reduce(mixed(own + np.uint64(0x632BE59BD9B4E019)), keepdims=True)
    return mixed(a).tobytes() + mixed(b).tobytes()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = _signed(np.concatenate(parts)) if len(parts) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), pa.array(flat))


def _short(values: np.ndarray) -> np.ndarray:
    """The upper half of each hash: enough to count by."""
    return (values >> np.uint64(32)).astype(np.uint32)


def _listed(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values a sorted list holds."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _prefix_tokens(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The shingles at the front of the hash order of every text, somewhat beyond the prefix, by their upper halves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, offsets in byte_slices(batch.column(0)):
                fronts = [s[: 1 + int(1.25 * prefix_length(len(s), percent))] for s in shingles(flat, offsets, width)]
                yield pa.RecordBatch.from_arrays([pa.array(_short(np.concatenate(fronts)).view(np.int32))], ["token"])

    return docs.select("text").mapInArrow(frugal(work), "token int")


def _frequent(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """Upper halves of the most frequent shingles (at most FREQUENT), sorted. They only shape the order; no result depends on them."""
    counted = _prefix_tokens(docs, width, percent).groupBy("token").count().where(F.col("count") >= FREQUENT_FROM)
    rows = counted.orderBy(F.desc("count"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(np.array(rows.column(0), np.int32).view(np.uint32))


def _sets(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, h, k (the first half of h as a number), sketch, prefix of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, flat, offsets in byte_slices(batch.column(1)):
                sets = shingles(flat, offsets, width)
                prefixes = []
                for own in sets:
                    common = _listed(_short(own), frequent)
                    want = prefix_length(len(own), percent) if len(own) else 0
                    rare = own[~common][:want]
                    prefixes.append(rare if len(rare) == want else np.concatenate([rare, own[common][: want - len(rare)]]))
                digests = [_digest(own) for own in sets]
                halves = pa.array(np.frombuffer(b"".join(d[:8] for d in digests), np.int64))
                columns = [batch.column(0).slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), halves, pa.array([sketch_of(s) for s in sets], pa.binary()), _lists(prefixes)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h", "k", "sketch", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(frugal(work), "doc_id long, n long, h binary, k long, sketch binary, prefix array<long>")


def _tiled(rows: DataFrame, size: Column, tile: int, key: str) -> DataFrame:
    """Columns i, j, part: rows of a group of `size` rows copied to the tiles of its parts; one tile for small groups."""
    parts = F.ceil(size / F.lit(tile)).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("tile"), key), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")


def _candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning edges, by k, of the classes that meet in a prefix shingle and pass the lossless bounds.

    Half a digest is enough here: two classes that share it only meet all the more, and are told apart where they are joined.
    """
    tokens = classes.select(F.explode("prefix").alias("token"), "k")
    # Counted by pre-aggregation: a shingle of many classes is no single task's, and its rows are split where they are joined.
    shared = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    met = _tiled(tokens.join(shared, "token"), F.col("c"), GROUP_TILE, "k").select("token", "i", "j", "k")
    met = met.join(classes.select("k", "n", "sketch"), "k")
    run = F.xxhash64("token", "i", "j")
    met = met.select(run.alias("run"), "k", F.col("n").cast("int").alias("n"), "sketch").repartition("run").sortWithinPartitions("run", "k")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[bytes] = set()
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for row in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if held and held[0][0] != row[0]:
                    edges += _survivors(held, percent, seen)
                    held = []
                held.append(row)
            yield _edge_batch(edges)
        yield _edge_batch(_survivors(held, percent, seen))

    return met.mapInArrow(frugal(work), "a long, b long").distinct()


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _survivors(run: list[tuple], percent: int, seen: set) -> list[tuple[int, int]]:
    """Edges that span the components of one run's may-link graph: each found member looks at the rest only."""
    if len(run) < 2:
        return []
    mark = hashlib.blake2b(np.array([r[1] for r in run], np.int64).tobytes(), digest_size=16).digest()
    if mark in seen:
        return []
    if len(seen) > SEEN_RUNS:
        seen.clear()
    seen.add(mark)
    if len(run) >= 64:
        return _many_survivors(run, percent)
    rest = [(r[1], (r[2], 8 * len(r[3]), int.from_bytes(r[3], "little"))) for r in run]
    edges = []
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and rest:
            own, left = queue.pop()[1], []
            for other in rest:
                if may_link(own, other[1], percent):
                    queue.append(other)
                    if other[0] != root[0]:
                        edges.append((root[0], other[0]))
                else:
                    left.append(other)
            rest = left
    return edges


def _many_survivors(run: list[tuple], percent: int) -> list[tuple[int, int]]:
    """What _survivors does, with one vectorised look at all that is left per member.

    Sizes that may link are less than a factor of two apart, and so are the sketches' widths: each is held as it is
    and folded once.
    """
    n = np.array([r[2] for r in run])
    bits = np.array([len(r[3]) for r in run])
    own, folded = {}, {}
    for wide in set(bits.tolist()):
        rows = np.frombuffer(b"".join(r[3] for r in run if len(r[3]) == wide), np.uint8).reshape(-1, wide)
        place = np.flatnonzero(bits == wide)
        own[wide] = dict(zip(place.tolist(), rows, strict=True))
        folded[wide] = dict(zip(place.tolist(), rows[:, : wide // 2] ^ rows[:, wide // 2 :], strict=True))
    rest, edges = np.arange(len(run)), []
    while len(rest) > 1:
        root, queue, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            fits = 100 * np.minimum(n[at], n[rest]) >= percent * np.maximum(n[at], n[rest])
            linked = np.zeros(len(rest), bool)
            wide = int(bits[at])
            for theirs, mine, table in ((wide, own[wide][at], own), (2 * wide, own[wide][at], folded), (wide // 2, folded[wide][at], own)):
                who = np.flatnonzero(fits & (bits[rest] == theirs))
                if len(who):
                    others = np.stack([table[theirs][i] for i in rest[who].tolist()])
                    apart = np.bitwise_count(others ^ mine).sum(1, dtype=np.int64)
                    linked[who] = (100 + percent) * apart <= (100 - percent) * (n[at] + n[rest[who]])
            found = rest[linked].tolist()
            queue += found
            edges += [(run[root][1], run[other][1]) for other in found if run[other][1] != run[root][1]]
            rest = rest[~linked]
    return edges


class Trie:
    """Sets in one order (frequent first) as a compressed trie: sorted sequences and what neighbours share."""

    def __init__(self, sets: list[np.ndarray]):
        tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        ranked = rank[inverse]
        self.width = len(tokens)
        self.sets = [np.sort(ranked[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        self.sizes = np.array([len(self.sets[i]) for i in self.order])
        shared = [0]
        for a, b in zip(self.order[:-1], self.order[1:], strict=True):
            x, y = self.sets[a], self.sets[b]
            n = min(len(x), len(y))
            apart = np.flatnonzero(x[:n] != y[:n])
            shared.append(int(apart[0]) if len(apart) else n)
        self.shared = np.array(shared)

    def overlaps(self, probes: list[int], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(set, overlaps with each probe) for the leaves that the bounds let the probes reach."""
        has = np.zeros((self.width, len(probes)), np.uint8)
        for at, probe in enumerate(probes):
            has[self.sets[probe], at] = 1
        own = np.array([len(self.sets[p]) for p in probes])
        todo = [(0, len(self.order), 0, np.zeros(len(probes), np.int64))]
        while todo:
            lo, hi, depth, overlap = todo.pop()
            path = self.sets[self.order[lo]]
            common = int(self.shared[lo + 1 : hi].min()) if hi - lo > 1 else len(path)
            if common > depth:
                overlap = overlap + has[path[depth:common]].sum(0, dtype=np.int64)
            longest = int(self.sizes[lo:hi].max())
            # Even if all that remains of the longest set matched: overlap >= t / (1 + t) * (both sizes).
            if not ((100 + percent) * (overlap + longest - common) >= percent * (own + longest)).any():
                continue
            if hi - lo == 1:
                yield self.order[lo], overlap
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(self.shared[lo + 1 : hi] == common)).tolist(), hi]
            todo += [(a, b, common, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def join_sets(sets: list[np.ndarray], weights: np.ndarray, percent: int, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the weights of a set's links, first set of its component) for distinct sets.

    With parts only pairs across the parts count, also where all sets here are of one part.
    """
    trie, links, root = Trie(sets), np.zeros(len(sets), np.int64), np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    turn = min(256, max(8, PROBE_CELLS // max(1, trie.width)))
    for begin in range(0, len(sets), turn):
        probes = list(range(begin, min(len(sets), begin + turn)))
        for leaf, overlap in trie.overlaps(probes, percent):
            linked = 100 * overlap >= percent * (sizes[probes] + sizes[leaf] - overlap)
            if parts is not None:
                linked &= parts[probes] != parts[leaf]
            who = begin + np.flatnonzero(linked)
            who = who[who != leaf]
            if len(who):
                links[who] += weights[leaf]
                roots = np.unique(np.append(root[who], root[leaf]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
    return links, root


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with doc_id of ids (null equals null): broadcast up to BROADCAST_IDS, else shuffled."""
    ids = settled(ids.select(F.col("doc_id").alias("_id")).distinct())
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs["doc_id"].eqNullSafe(ids["_id"]), how)


def similar_documents(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs (doc_id, text).

    component_id is the smallest id that links reach, n_links counts the other rows that a row links with.
    Rows without words (null or blank text) have no shingles, no links and their own id as component. Rows with a null id take
    part; where no row of a component has an id it is null. Repeated rows and ids stay and link. An empty
    table gives an empty result. Names of other columns do not matter.
    """
    return _similar(docs, percent, width).select("doc_id", "n_shingles", "component_id", "n_links")


def _similar(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """What similar_documents gives, the digest h of the row's set, and `lead`.

    lead is true for the rows of one id and one set per component: the smallest id (null comes last), then the smallest digest.
    """
    docs = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = settled(_sets(docs, width, percent, _frequent(docs, width, percent)))
    members = sets.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("k").alias("k"))
    classes = sets.where("n > 0").select("h", "k", "n", "sketch", "prefix").dropDuplicates(["h"])
    edges = settled(_candidate_edges(classes, percent))
    blocks = settled(components(edges).select(F.col("node").alias("k"), F.col("component").alias("block")).join(members, "k"))
    sized = blocks.join(blocks.groupBy("block").agg(F.sum("n").alias("size")), "block")
    tiles = _tiled(sized, F.col("size"), BLOCK_TILE, "h").select("block", "i", "j", "part", "h", "members")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, offsets in byte_slices(batch.column(0)):
                own = shingles(flat, offsets, width)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in own], pa.binary()), _lists(own)], ["h", "tokens"])

    chosen = by_ids(docs, blocks.select(F.col("first_id").alias("doc_id")), "left_semi").select("text")
    tokens = chosen.mapInArrow(frugal(full_sets), "h binary, tokens array<long>").dropDuplicates(["h"])

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        # A tile of one part holds its inner pairs, a tile of two only those across.
        parts = np.array(rows.column("part")) if key[1].as_py() != key[2].as_py() else None
        lists = rows.column("tokens").combine_chunks()
        flat, at = np.array(lists.values, np.int64).view(np.uint64), np.array(lists.offsets)
        links, root = join_sets([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], np.array(rows.column("members")), percent, parts)
        return pa.table({"h": rows.column("h"), "links": links, "root": rows.column("h").take(pa.array(root))})

    joined = tiles.join(tokens, "h").groupBy("block", "i", "j").applyInArrow(verify, "h binary, links long, root binary")
    joined = settled(joined)
    linked = joined.groupBy("h").agg(F.sum("links").alias("links"))
    whole = components(joined.where("h <> root").select(F.col("h").alias("a"), F.col("root").alias("b")))
    whole = whole.select(F.col("node").alias("h"), F.col("component").alias("root"))
    front = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "h")
    least = whole.join(members, "h").groupBy("root").agg(F.min("first_id").alias("least_id"), F.min(front).alias("front"))
    known = members.join(linked, "h", "left").join(whole.join(least, "root").select("h", "least_id", "front"), "h", "left")
    in_front = F.col("front").isNull() | (F.col("h") == F.col("front.h"))
    known = known.select("h", F.coalesce("least_id", "first_id").alias("_component"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("_links"), in_front.alias("_front"))
    out = sets.select("doc_id", "n", "h").join(known, "h", "left")
    empty = F.col("n") == 0
    lead = empty | (F.col("_front") & F.col("doc_id").eqNullSafe(F.col("_component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("_component")).alias("component_id"), F.when(empty, 0).otherwise(F.col("_links")).cast("long").alias("n_links"), "h", lead.alias("lead"))


def _with_digests(docs: DataFrame, width: int) -> DataFrame:
    """docs with its columns named c0, c1, ... and n, h of each row's set."""
    text, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, flat, offsets in byte_slices(batch.column(text)):
                sets = shingles(flat, offsets, width)
                columns = [column.slice(first, last - first) for column in batch.columns]
                columns += [pa.array([len(own) for own in sets], pa.int64()), pa.array([_digest(own) for own in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n", "h"])

    plain = docs.toDF(*names)
    schema = StructType([*plain.schema.fields, StructField("n", LongType()), StructField("h", BinaryType())])
    return plain.mapInArrow(frugal(work), schema)


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs with one row of each component: one with the smallest id (null comes last; an arbitrary one of equal id and set).

    Rows without words all stay. Rows are told apart by id and set, so those that share an id, or have none, are decided each
    for itself. Only rows of such ids are digested again; the rest is dropped by id.
    """
    found = settled(_similar(docs, percent, width).select("doc_id", "h", (F.col("n_links") > 0).alias("linked"), "lead"))
    stays = ~F.col("linked") | F.col("lead")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("count"), F.bool_or("linked").alias("linked"), F.bool_or(stays).alias("stays"))
    # Ids of which no row stays, and ids of several rows that need a look at each.
    ids = settled(ids.where("linked and (count > 1 or not stays)").select("doc_id", F.col("stays").alias("mixed")))
    kept = by_ids(docs, ids, "left_anti")
    mixed = ids.where("mixed")
    if mixed.isEmpty():
        return kept
    doc_id = f"c{docs.columns.index('doc_id')}"
    rows = _with_digests(by_ids(docs, mixed, "left_semi"), width)
    # Rows of one id and set link with each other. Leaving one of them before the join also leaves no hot key.
    once = rows.where("n > 0").dropDuplicates([doc_id, "h"])
    gone = found.where(~stays).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    once = once.join(gone, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_anti")
    back = once.unionByName(rows.where("n = 0")).drop("n", "h").toDF(*docs.columns)
    return kept.unionByName(back)
