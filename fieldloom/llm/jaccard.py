"""N-gram Jaccard join: texts whose sets of word shingles overlap enough, by R-trees over count vectors.

How many sets hold each shingle is counted exactly: the sets are dealt by hash into buckets, packed, a
row for each batch of texts and bucket; counted there; and what several sets hold goes back to its
batch. A shingle of one set alone is shared with nobody, so from then on a set is its shared ones, and
texts are not read again.

Two sets that reach the threshold share one of their rarest few shingles (the prefix filter). Each set
goes to the tiles of those: a tile is named by its least member, so texts of one family meet in few. In
a tile each set is a point, the counts of its shingles by hash group; an R-tree over the points bounds
the overlap of a set with all below a node by the summed minima of its counts and the node's largest;
what survives the bound is verified on the sets themselves.

(One R-tree over all points cannot do this alone: with groups enough to tell texts apart, the boxes
of a large tree overlap in every direction, so each query would visit most leaves.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ._common import arrow_map, discard, joined, settled, tiles, written
from .components import components
from .shingles import Shingler, mix

_U = np.uint64
#: Shingles a batch of texts holds, and those a bucket is meant to hold: buckets grow with the corpus.
BATCH, BUCKET = 1 << 19, 1 << 20
#: A shingle that so many sets of a batch hold is sent once, with its count.
OFTEN = 32
#: Digests a task remembers before it starts afresh.
SEEN = 1 << 16
#: Sets one task joins: larger tiles are cut in chunks of about so many.
TILE = 128
LEAF, FANOUT = 16, 8
#: A prefix is kept longer by so many shingles: sets that link share so many more of the longer ones.
EXTRA = 3


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums over the set."""
    with np.errstate(over="ignore"):
        pair = np.array([mix(s).sum(dtype=_U), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)], _U)
    a, b = pair.view(np.int64).tolist()
    return a, b


def need(a, b, threshold: int):
    """The least overlap of sets of sizes a and b: 100 i >= threshold (a + b - i)."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix_length(n, threshold: int):
    return n - -(-threshold * n // 100) + 1


def described(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2): the set's size and digest, null digests for an empty set."""

    def make():
        shingler = Shingler(words)

        def one(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                found = shingler.sets(batch.column(1).slice(at, 500))
                digests = [digest(s) if len(s) else (None, None) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 500), pa.array(map(len, found), pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())],
                    names=["doc_id", "n_shingles", "d1", "d2"],
                )

        return one

    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_shingles bigint, d1 bigint, d2 bigint")


# --- counting: batches to buckets and back


def _seven(h: np.ndarray) -> bytes:
    """Hashes without their top byte, which their bucket tells."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _eight(raw: bytes, top: int) -> np.ndarray:
    out = np.empty((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    out[:, 7] = top
    return out.view("<u8").ravel().astype(_U)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in one, two or four bytes each, whichever do for all."""
    top = int(x.max()) if len(x) else 0
    return x.astype("u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // n if n else 1]).astype(np.int64)


_DEALT = pa.schema([("k", pa.int32()), ("batch", pa.int64()), ("docs", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_BACK = pa.schema([("k", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_PLAYS = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("room", pa.int64()), ("prefix", pa.binary()), ("shared", pa.binary())])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'bigint', pa.binary(): 'binary'})[f.type]}" for f in schema)


class Dealer:
    """One task's sets as rows for the buckets.

    A row for each batch and bucket: a: shingles, by the set they are of; b: how many of each of the
    batch's `docs` sets, or, where `docs` is 0 and they are few, the set of each; c: shingles that OFTEN or more of them hold; d: how many do. A header for
    each batch, under a number below 0: a: digests; b: sizes; c, d: (shingle, set) of those of c.
    A set met in the task before is left out.
    """

    def __init__(self, words: int, bits: int, partition: int):
        self.shingler, self.bits, self.batch = Shingler(words), bits, partition << 32
        self.seen: set[int] = set()
        self.nodes, self.sets, self.held = [], [], 0

    def __call__(self, batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 500):
            for s in self.shingler.sets(batch.column(0).slice(at, 500)):
                if len(s) and (d := digest(s)[0]) not in self.seen:
                    self.seen.add(d)
                    self.nodes.append(d)
                    self.sets.append(s)
                    self.held += len(s)
                    if self.held >= BATCH:
                        yield self.flush()
        if len(self.seen) > SEEN:
            self.seen.clear()

    def flush(self) -> pa.RecordBatch:
        n = len(self.sets)
        sizes = np.array([len(s) for s in self.sets], np.int64)
        h, owner = np.concatenate(self.sets), np.repeat(np.arange(n, dtype=np.uint32), sizes)
        self.sets = []
        order = np.sort(h)
        first = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
        count = np.diff(first, append=len(order))
        common, often = order[first[count >= OFTEN]], count[count >= OFTEN]
        rows = []
        c, d = h[:0], owner[:0]
        if len(common):
            hit = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
            c, d = h[hit], owner[hit]
            h, owner = h[~hit], owner[~hit]
        shift = _U(64 - self.bits)
        bucket = (h >> shift).astype(np.uint16 if self.bits <= 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        h, owner, bucket = h[order], owner[order], bucket[order]
        of = (common >> shift).astype(np.int64)
        all_ = np.union1d(bucket, of).astype(np.int64)
        ends, ends_c = np.searchsorted(bucket, all_, side="right"), np.searchsorted(of, all_, side="right")
        begin, begin_c = np.searchsorted(bucket, all_), np.searchsorted(of, all_)
        for k, x, y, u, v in zip(all_.tolist(), begin.tolist(), ends.tolist(), begin_c.tolist(), ends_c.tolist()):
            own = owner[x:y]
            few = 2 * len(own) < n
            rows.append((k, self.batch, 0 if few else n, _seven(h[x:y]), _small(own if few else np.bincount(own, minlength=n)), _seven(common[u:v]), often[u:v].astype("<u4").tobytes()))
        head = -1 - (self.batch * 0x9E3779B1 >> 8) % (1 << self.bits)
        rows.append((head, self.batch, n, np.array(self.nodes, "<i8").tobytes(), sizes.astype("<i8").tobytes(), c.astype("<u8").tobytes(), d.astype("<u4").tobytes()))
        self.batch += 1
        self.nodes, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _DEALT.types)], schema=_DEALT)

    def finish(self):
        if self.sets:
            yield self.flush()


def _count(bits: int):
    """A bucket's rows -> rows for their batches: kind 0 the header as it was; 1: a: shingles of several
    sets, b: the sets, c: levels (eight times the logarithm of how many sets hold it); 2: a, c of the OFTEN ones."""

    def tile(table: pa.Table):
        rows = [table.column(x).to_pylist() for x in _DEALT.names]
        if rows[0][0] < 0:
            yield from ((batch, 0, a, b, c, d) for batch, a, b, c, d in zip(rows[1], *rows[3:]))
            return
        top = rows[0][0] >> (bits - 8)
        single, common = [_eight(a, top) for a in rows[3]], [_eight(c, top) for c in rows[5]]
        h = np.concatenate([*single, *common])
        weight = np.concatenate([np.ones(sum(map(len, single)), np.int64), *(np.frombuffer(d, "<u4").astype(np.int64) for d in rows[6])])
        order = np.argsort(h, kind="stable")
        sorted_ = h[order]
        start = np.r_[True, sorted_[1:] != sorted_[:-1]]
        sums = np.add.reduceat(weight[order], np.flatnonzero(start))
        held = np.empty(len(h), np.int64)
        held[order] = sums[np.cumsum(start) - 1]
        level = np.minimum(8 * np.log2(held), 255).astype(np.uint8)
        at = 0
        for batch, n, s, counts in zip(rows[1], rows[2], single, rows[4]):
            part = slice(at, at + len(s))
            keep = held[part] > 1
            if keep.any():
                owner = np.repeat(np.arange(n), _large(counts, n)) if n else _large(counts, len(s))
                yield batch, 1, s[keep].astype("<u8").tobytes(), owner[keep].astype("<u4").tobytes(), level[part][keep].tobytes(), None
            at += len(s)
        for batch, c in zip(rows[1], common):
            if len(c):
                yield batch, 2, c.astype("<u8").tobytes(), None, level[at : at + len(c)].tobytes(), None
            at += len(c)

    return tiles(tile, _BACK)


def _choose(threshold: int):
    """A batch's rows -> (node, n_shingles, room, prefix, shared) of the sets whose rarest shingles are not all
    their own. room: how many of the prefix make the shortest; EXTRA more follow."""

    def tile(table: pa.Table):
        kind, a, b, c, d = (table.column(x).to_pylist() for x in ("kind", "a", "b", "c", "d"))
        head = kind.index(0)
        nodes, sizes = np.frombuffer(a[head], "<i8"), np.frombuffer(b[head], "<i8")
        one, two = [i for i, x in enumerate(kind) if x == 1], [i for i, x in enumerate(kind) if x == 2]
        h = [np.frombuffer(a[i], "<u8") for i in one]
        owner = [np.frombuffer(b[i], "<u4") for i in one]
        level = [np.frombuffer(c[i], "u1") for i in one]
        if two:
            common, of = np.concatenate([np.frombuffer(a[i], "<u8") for i in two]), np.concatenate([np.frombuffer(c[i], "u1") for i in two])
            order = np.argsort(common)
            often = np.frombuffer(c[head], "<u8")
            h.append(often)
            owner.append(np.frombuffer(d[head], "<u4"))
            level.append(of[order][np.searchsorted(common[order], often)])
        if not h:
            return
        h, owner, level = np.concatenate(h), np.concatenate(owner).astype(np.int64), np.concatenate(level)
        # a set's own shingles are its rarest; of the others so many as the prefix has room for
        count = np.bincount(owner, minlength=len(nodes))
        room = prefix_length(sizes, threshold) - (sizes - count)
        keep = room[owner] > 0
        h, owner, level = h[keep], owner[keep], level[keep]
        order = np.lexsort((h, level, owner))
        by_owner = np.lexsort((h, owner))
        who, first = np.unique(owner[order], return_index=True)
        for o, f in zip(who.tolist(), first.tolist()):
            n = int(count[o])
            yield int(nodes[o]), int(sizes[o]), int(room[o]), h[order[f : f + min(n, int(room[o]) + EXTRA)]].tobytes(), h[by_owner[f : f + n]].tobytes()

    return tiles(tile, _PLAYS)


def plays(docs: DataFrame, text_col: str, words: int, threshold: int, total: int) -> DataFrame:
    """(node, n_shingles, room, prefix, shared) of distinct sets that may link: node is the digest's first
    half, shared the sorted shingles that other sets hold too, prefix the rarest of them, of which the
    first `room` are the shortest prefix. total: shingles of all texts."""
    bits = max(8, int(np.ceil(np.log2(max(total, 1) / BUCKET))))

    def dealer():
        from pyspark import TaskContext

        return Dealer(words, bits, TaskContext.get().partitionId())

    dealt = arrow_map(docs.select(text_col), dealer, _sql(_DEALT))
    back = arrow_map(dealt.repartition("k").sortWithinPartitions("k", "batch"), _count(bits), _sql(_BACK))
    found = arrow_map(back.repartition("k").sortWithinPartitions("k", "kind"), _choose(threshold), _sql(_PLAYS))
    # equal sets of several tasks
    return written(found.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n_shingles", "room", "prefix", "shared"))), "plays")


# --- tiles


def group_bits(n: int) -> int:
    """Groups for a set of n shingles, as a power of two: about five shingles a group."""
    return min(12, max(4, int(np.ceil(np.log2(max(n / 5, 1))))))


def counts_of(sets: list[np.ndarray]) -> np.ndarray:
    """Each set's point: the counts of its shingles by hash group."""
    bits = group_bits(max(map(len, sets)))
    return np.stack([np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) for s in sets])


class RTree:
    """Points bulk-loaded by splitting at the widest coordinate; nodes keep each coordinate's largest
    value and the least size below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order: list[int] = []
        bounds: list[tuple[int, int]] = []
        todo = [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                bounds.append((len(order), len(order) + len(part)))
                order += part.tolist()
                continue
            own = points[part]
            axis = int((own.max(0) - own.min(0)).argmax())
            part = part[np.argsort(own[:, axis], kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.order = np.array(order)
        self.leaves = bounds
        # levels of nodes, the leaves first: (largest counts, least sizes); node i holds FANOUT from i * FANOUT on
        high = np.stack([points[self.order[a:b]].max(0) for a, b in bounds])
        low = np.array([sizes[self.order[a:b]].min() for a, b in bounds])
        self.tree = [(high, low)]
        while len(high) > FANOUT:
            cut = range(0, len(high), FANOUT)
            high, low = np.stack([high[i : i + FANOUT].max(0) for i in cut]), np.array([low[i : i + FANOUT].min() for i in cut])
            self.tree.append((high, low))

    def near(self, point: np.ndarray, size: int, threshold: int) -> np.ndarray:
        """Indices of points whose overlap with this one may reach what is needed."""
        nodes = np.arange(len(self.tree[-1][0]))
        for depth in range(len(self.tree) - 1, -1, -1):
            high, low = self.tree[depth]
            least = np.maximum(low[nodes], -(-threshold * size // 100))
            nodes = nodes[np.minimum(high[nodes], point).sum(1) >= need(size, least, threshold)]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.tree[depth - 1][0])]
        if not len(nodes):
            return nodes
        found = np.concatenate([self.order[a:b] for a, b in (self.leaves[n] for n in nodes)])
        least = need(size, self.sizes[found], threshold)
        return found[np.minimum(self.points[found], point).sum(1) >= least]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Tile:
    """Links within one tile, or between its two sides if some members are marked.

    sizes are those of whole sets; the sets given need only hold what any two may share. every: all
    links; else only enough to connect what is connected, and pairs already connected are not
    verified again.
    """

    def __init__(self, threshold: int, every: bool):
        self.threshold, self.every = threshold, every

    def links(self, ids: list[int], sizes: np.ndarray, sets: list[np.ndarray], marked: list[bool] | None = None, given: list[int] | None = None):
        points = counts_of(sets)
        tree = RTree(points, sizes)
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if given is not None:
            first: dict[int, int] = {}
            for i, g in enumerate(given):
                parent[i] = first.setdefault(g, i)
        for i in np.argsort(ids, kind="stable").tolist():
            if marked is not None and not marked[i]:
                continue
            for j in tree.near(points[i], int(sizes[i]), self.threshold).tolist():
                if (ids[j] <= ids[i] if marked is None or marked[j] else ids[j] == ids[i]) or (not self.every and root(i) == root(j)):
                    continue
                both = overlap(sets[i], sets[j])
                if (100 + self.threshold) * both >= self.threshold * int(sizes[i] + sizes[j]):
                    yield i, j, both
                    a, b = root(i), root(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)


def prefix_entries(sets: DataFrame, extra: int = 0) -> DataFrame:
    """(h, node) for each shingle of each set's prefix, which is `extra` longer than the shortest. sets: plays()."""

    def make():
        def one(batch: pa.RecordBatch):
            room, raw = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            raw = [r[: 8 * (n + extra)] for n, r in zip(room, raw)]
            spread = np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), "<i8")), batch.column(0).take(pa.array(spread))], names=["h", "node"])

        return one

    return arrow_map(sets.select("node", "room", "prefix"), make, "h bigint, node bigint")


def tile_members(sets: DataFrame) -> DataFrame:
    """(leader, node): sets, each in the tile of the least node it shares a rare shingle with, leaders
    among them. sets: plays()."""
    entries = prefix_entries(sets)
    first = entries.groupBy("h").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("n")).where("leader < last").drop("last")
    first = written(first, "leaders", gather=True)
    led = joined(entries, first, ["h"], "n").where("node <> leader")
    pairs = written(led.groupBy("leader", "node").agg(F.lit(1).alias("one")).drop("one"), "pairs", gather=True)
    discard(first)
    return pairs


def links(docs: DataFrame, words: int = 5, threshold: int = 80, every: bool = False, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, pairs). rows: (doc_id, n_shingles, d1, d2); classes: (node, rep, d1, d2, n_shingles, copies), one
    for each distinct set; pairs: (a, b, overlap), linked nodes a < b — all with `every`, else enough to connect them."""
    docs = settled(docs.select(id_col, text_col), "texts")
    rows = written(described(docs, id_col, text_col, words), "rows")
    # equal sets collapse before anything is compared: a group of copies is one node
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.col("d1")), "classes", gather=True)
    sets = plays(docs, text_col, words, threshold, rows.agg(F.sum("n_shingles")).first()[0] or 0)
    discard(docs)
    pairs = tile_members(sets)
    sizes = written(pairs.groupBy("leader").agg(F.count("*").alias("n")), "tiles", gather=True)
    large = sizes.where(F.col("n") >= TILE).withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
    large = written(large, "large-tiles", gather=True)
    if large.isEmpty():
        members = pairs.withColumn("chunk", F.lit(0)).unionByName(sizes.select("leader", F.col("leader").alias("node"), F.lit(0).alias("chunk")))
    else:
        # members go to a chunk each, the leader to all of them
        spread = joined(pairs, large, ["leader"], "n", "left").select("leader", "node", F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), F.lit(0)).cast("int").alias("chunk"))
        heads = sizes.join(large.drop("n"), "leader", "left").select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
        members = spread.unionByName(heads)
    members = written(members, "members", gather=True)
    dealt = members.select(F.col("leader").alias("k1"), F.col("chunk").alias("k2"), F.lit(0).alias("k3"), "node", F.lit(0).cast("long").alias("side"), F.lit(0).cast("long").alias("given"))
    found = written(_verified(dealt, sets, threshold, every), "links", gather=True)
    if not large.isEmpty():
        more = written(_across(members, large, sets, found, threshold, every), "links", gather=True)
        found = found.unionByName(more)
    discard(pairs, sizes, large, members, sets)
    return rows, classes, found.distinct()


def _across(members, large, sets, found, threshold, every) -> DataFrame:
    """Links between chunks of large tiles: members their chunk did not connect to the leader, the loose
    ones, against all others. With `every`, all members against all other chunks.

    Sets that link share EXTRA + 1 shingles of their prefixes of that much more. So a loose member is
    compared with those alone that share one of its prefix shingles other than the EXTRA which most of the
    tile's members have: it is found in one of the rest. Where that takes more rows than to compare the
    loose ones with all, as among near copies of one text, TILE and TILE at a time, the latter is done.
    Either finds all links.
    """
    roots = components(found.select(F.col("b").alias("node"), F.col("a").alias("root"))).withColumnRenamed("root", "own")
    top = large.join(roots, F.col("leader") == F.col("node"), "left").select("leader", F.coalesce("own", "leader").alias("top"), "chunks", "n")
    rest = joined(members.where("node <> leader"), written(top, "tops", gather=True), ["leader"], "n").join(roots, "node", "left").withColumn("own", F.coalesce("own", "node"))
    rest = written(rest, "large", gather=True)
    loose = rest if every else rest.where("own <> top")
    some = loose.groupBy("leader").agg(F.count("*").alias("loose"), F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    some = written(some.join(large.select("leader", "n"), "leader"), "loose", gather=True)
    if every:
        return _verified(_blocks(loose, rest, some, True), sets, threshold, True)
    lists, kept, entries = _lists(rest, some, sets)
    costs = lists.groupBy("leader").agg(F.sum(F.col("loose") * F.col("chunks") + F.col("n") * F.col("parts")).alias("cost"))
    costs = some.join(costs, "leader", "left").withColumn("split", F.coalesce("cost", F.lit(0)) < F.col("loose") * F.ceil(F.col("n") / TILE) + F.col("n") * F.col("parts"))
    costs = written(costs, "costs", gather=True)
    whole = costs.where("not split").select("leader", "n", "parts")
    lists = written(lists.join(costs.where("split").select("leader"), "leader"), "split", gather=True)
    ways = [F.xxhash64("leader", "h").alias("k1"), "k2", "k3", "node", "side", F.col("own").alias("given")]
    left = joined(kept, lists, ["leader", "h"], "loose").withColumn("k2", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    left = left.withColumns({"k3": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "side": F.lit(1).cast("long")}).select(*ways)
    right = joined(entries.drop("loose"), lists.drop("loose"), ["leader", "h"], "n").withColumn("k3", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    right = right.withColumns({"k2": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "side": F.lit(0).cast("long")}).select(*ways)
    return _verified(left.unionByName(right).unionByName(_blocks(loose, rest, whole, False)), sets, threshold, False)


def _lists(rest: DataFrame, some: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, kept, entries) of tiles with loose members. entries: (leader, h, node, own, loose), members by
    their longer prefixes' shingles; kept: those of loose members but for the EXTRA most frequent of each;
    lists: (leader, h, loose, n, parts, chunks), how many of either a shingle has, and the blocks they make."""
    marked = joined(rest, some.select("leader", "n"), ["leader"], "n").select("leader", "node", "own", (F.col("own") != F.col("top")).alias("loose"))
    entries = written(marked.join(prefix_entries(sets, EXTRA), "node").select("leader", "h", "node", "own", "loose"), "entries")
    sizes = entries.groupBy("leader", "h").agg(F.count("*").alias("n"), F.count_if("loose").alias("loose")).where("n > 1 and loose > 0")
    sizes = written(sizes, "sizes", gather=True)
    # the rows of `entries` that are loose have these weights
    of_loose = joined(entries.where("loose").drop("loose"), sizes, ["leader", "h"], "loose")
    rank = F.row_number().over(W.partitionBy("leader", "node").orderBy(F.desc("n"), "h"))
    kept = written(of_loose.withColumn("rank", rank).where(F.col("rank") > EXTRA).select("leader", "h", "node", "own"), "kept-entries", gather=True)
    lists = kept.groupBy("leader", "h").agg(F.count("*").alias("loose")).join(sizes.select("leader", "h", "n"), ["leader", "h"])
    lists = written(lists.withColumns({"parts": F.ceil(F.col("loose") / TILE).cast("int"), "chunks": F.ceil(F.col("n") / TILE).cast("int")}), "lists", gather=True)
    return lists, kept, entries


def _blocks(loose: DataFrame, rest: DataFrame, some: DataFrame, every: bool) -> DataFrame:
    """_verified's rows of the tiles in `some` (leader, n, parts): loose members against all, TILE and TILE at a time."""
    left = joined(loose, some, ["leader"], "n")
    left = left.withColumn("k2", F.col("chunk") if every else F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    left = left.select("leader", "node", "own", F.lit(1).cast("long").alias("side"), "k2", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k3"))
    right = joined(rest, some, ["leader"], "n")
    right = right.select("leader", "node", "own", F.lit(0).cast("long").alias("side"), F.explode(F.sequence(F.lit(0), (F.col("chunks") if every else F.col("parts")) - 1)).alias("k2"), F.col("chunk").alias("k3"))
    both = left.unionByName(right)
    return (both.where("k2 <> k3") if every else both).select(F.col("leader").alias("k1"), "k2", "k3", "node", "side", F.col("own").alias("given"))


def _verified(members: DataFrame, sets: DataFrame, threshold: int, every: bool) -> DataFrame:
    """(a, b, overlap) out of rows (k1, k2, k3, node, side, given): each key's sets meet in one task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])

    def tile(table: pa.Table):
        nodes, sides, given = (table.column(x).to_pylist() for x in ("node", "side", "given"))
        if len(nodes) < 2:
            return
        sizes = np.array(table.column("n_shingles").to_pylist(), np.int64)
        shared = [np.frombuffer(raw, "<u8").astype(_U) for raw in table.column("shared").to_pylist()]
        between = any(sides)
        for i, j, both in Tile(threshold, every).links(nodes, sizes, shared, [s == 1 for s in sides] if between else None, given if between and not every else None):
            yield min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), both

    rows = members.join(sets.select("node", "n_shingles", "shared"), "node")
    dealt = rows.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "node")
    return arrow_map(dealt, tiles(tile, schema), _sql(schema))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least id reachable by links.

    Words are runs of characters other than blank, tab, line ends and page breaks, A-Z made lower;
    fewer than `words` of them are one shingle. Rows of equal sets are linked. A text without words,
    or null: 0 shingles, its own component. A null id takes its component's least id, null if there
    is none; repeated rows stay; rows of one id and other texts go with their texts. An empty table
    gives no rows. Other columns aren't read. Shingles are compared by 64-bit hashes. Texts that come
    out of a shuffle are written first: batches are numbered by partition and place.
    """
    rows, classes, pairs = links(docs, words, threshold, False, id_col, text_col)
    roots = components(pairs.select(F.col("b").alias("node"), F.col("a").alias("root")))
    tied = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tied = written(tied.select("d1", "d2", "n_shingles", "rep", "copies", "root", (F.col("root") != F.col("node")).alias("linked")), "tied", gather=True)
    heads = tied.groupBy("root").agg(F.min("rep").alias("component_id"), F.max("linked").alias("linked"), F.count("*").alias("n")).where("linked").drop("linked")
    heads = written(heads, "heads", gather=True)
    grouped = written(joined(tied, heads, ["root"], "n", "left").select("d1", "d2", "n_shingles", "copies", F.coalesce("component_id", "rep").alias("component_id")), "grouped", gather=True)
    discard(classes, tied, heads)
    some = joined(rows.where("n_shingles > 0"), grouped, ["d1", "d2", "n_shingles"], "copies")
    none = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none.select("doc_id", "n_shingles", "component_id"))


def keep_one(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, that stay: of each component the row of the least id.

    Of several rows with that id one stays, the least by the text's hash. Rows without id all stay.
    Null and empty texts stay; an empty table gives no rows. Texts are shuffled once, to meet the ids that
    stay; only rows of repeated ids are ordered.
    """
    near = near_duplicates(docs, words, threshold, id_col, text_col).where("doc_id is not null")
    found = near.groupBy(F.col("doc_id").alias("__fl_id")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("rows")).where("stays")
    found = written(found.drop("stays"), "kept", gather=True)
    # the ids grow with the documents: never broadcast, whatever the size
    kept = docs.join(found.where("rows = 1").select("__fl_id").hint("shuffle_hash"), F.col(id_col) == F.col("__fl_id"), "left_semi")
    again = docs.join(found.where("rows > 1").select("__fl_id"), F.col(id_col) == F.col("__fl_id"), "left_semi")
    order = W.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    again = again.withColumn("__fl_rank", F.row_number().over(order)).where("__fl_rank = 1").drop("__fl_rank")
    return kept.unionByName(again).unionByName(docs.where(F.col(id_col).isNull()))
