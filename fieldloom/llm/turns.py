"""Prefix trie of conversations by LCP-aware external mergesort.

A turn is known by 128 bits of a SHA-256 of role and text and by its code points: the texts themselves
are never shuffled. A conversation is the string of its turns' digests, `seq`; byte order of `seq` keeps
equal prefixes together.

1. `runs`: each Arrow batch is sorted; every row carries the LCP (in turns) with its predecessor in that
   run. The runs are a written table.
2. `ranges`: runs are cut into ranges of (seq, conv_id), so that copies of one conversation, however
   many, spread over ranges. In a range a loser tree merges the runs: it compares LCPs first and turns
   only past the LCP both have with the last winner.
3. The merged stream and its LCPs drive a stack of open nodes. A node is finished, and handed on once
   its parent is, when the stream leaves its path. Only the paths of a range's first and last row may go
   on in other ranges: they leave as two rows of partial figures, `paths`.
4. `seams`: the same stack over those two rows a range. Ids of members that end on such paths travel
   apart, in pieces, and are hashed in one stream for each node (SHA-256 admits no other way).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import arrow_map, discard, ready, written

#: Bytes of a turn's digest.
WIDTH = 16
#: Conversations in a range, on average: what a task sorts and holds.
RANGE_ROWS = 32_768
#: Ids in one piece of an open node's ends.
PIECE_IDS = 65_536
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_COLUMNS = [f.split(" ")[0] for f in NODE.split(", ")]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(role: Column, text: Column) -> Column:
    """128 bits of role and text; the role's length parts them."""
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, seq, sizes): every conversation's first h turns are those of conversation c - c % group.

    h = crc32(decimal c) % heads. seq: the digests of the turns in order, joined; sizes: code points of
    their texts. One shuffle of narrow rows: a conversation lies with the one that it borrows from.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = F.col("c") - F.col("c") % group
    narrow = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("c"), F.struct("turn", _digest(role, text).alias("digest"), F.char_length(text).alias("size")).alias("t"))
    narrow = narrow.withColumn("base", base)
    # nulls come first in sorted arrays; equal turn numbers are put in the order of their digests
    own = narrow.repartition("base").groupBy("base", "c").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    first = own.where("c = base").select("base", F.slice("turns", 1, heads).alias("lent"))
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(heads)).cast("int")
    lent = F.coalesce("lent", F.slice("turns", 1, 0))
    both = own.join(first, "base", "left").select("c", F.concat(F.slice(lent, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
    return both.select(F.col("c").alias("conv_id"), F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that a and b begin with in common; `known` of them need no comparing."""
    most = min(len(a), len(b)) // WIDTH
    at = known
    while at < most and a[at * WIDTH : at * WIDTH + WIDTH] == b[at * WIDTH : at * WIDTH + WIDTH]:
        at += 1
    return at


def _sorted_runs(sequences: DataFrame) -> DataFrame:
    """(run, place, lcp, conv_id, seq, sizes): each batch of rows is a run, sorted by (seq, conv_id)."""

    def make():
        import uuid

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, seqs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (seqs[i], ids[i]))
            lcp, before = [], b""
            for i in order:
                lcp.append(common(before, seqs[i]))
                before = seqs[i]
            at = pa.array(order, pa.int64())
            run = uuid.uuid4().hex
            return pa.RecordBatch.from_arrays(
                [pa.array([run] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(lcp, pa.int32()), *(batch.column(c).take(at) for c in range(3))],
                names=["run", "place", "lcp", "conv_id", "seq", "sizes"],
            )

        return one

    return arrow_map(sequences.select("conv_id", "seq", "sizes"), make, "run string, place bigint, lcp int, conv_id bigint, seq binary, sizes array<int>")


class LoserTree:
    """Merges sorted runs of (seq, conv_id, lcp with the predecessor in its run, payload).

    Every run's head carries its LCP with the last winner. In a match the longer LCP is the smaller
    sequence, without a look at the turns; equal LCPs are compared from there on, and the loser keeps
    its LCP with the winner it lost to.
    """

    def __init__(self, runs: list[Iterable[tuple[bytes, int, int, object]]]):
        self.streams = [iter(r) for r in runs]
        self.compared = 0  # turns compared, for tests
        n = max(len(runs), 1)
        self.heads: list = [next(s, None) for s in self.streams] + [None] * (n - len(runs))
        self.lcp = [0] * n  # with the last winner: at first the empty sequence
        self.tree = [-1] * n  # losers; tree[0] is the winner
        self.n = n
        winners = [-1] * n + list(range(n))
        for at in range(n - 1, 0, -1):
            winners[at], self.tree[at] = self.play(winners[2 * at], winners[2 * at + 1])
        self.tree[0] = winners[1]

    def play(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if self.lcp[i] != self.lcp[j]:
            return (i, j) if self.lcp[i] > self.lcp[j] else (j, i)
        known = self.lcp[i]
        both = common(a[0], b[0], known)
        self.compared += both - known + 1
        rest_a, rest_b = a[0][both * WIDTH : both * WIDTH + WIDTH], b[0][both * WIDTH : both * WIDTH + WIDTH]
        first, last = (i, j) if (rest_a, a[1], i) < (rest_b, b[1], j) else (j, i)
        self.lcp[last] = both
        return first, last

    def __iter__(self) -> Iterator[tuple[bytes, int, int, object]]:
        """(seq, conv_id, LCP with the row before, payload) in order of (seq, conv_id)."""
        while (head := self.heads[self.tree[0]]) is not None:
            w = self.tree[0]
            yield head[0], head[1], self.lcp[w], head[3]
            self.heads[w] = following = next(self.streams[w], None)
            if following is not None:
                self.lcp[w] = following[2]
            at = (w + self.n) // 2
            while at:
                w, self.tree[at] = self.play(w, self.tree[at])
                at //= 2
            self.tree[0] = w


class _Open:
    """A node whose members are still coming. ids: of the members that end here, ascending; waiting:
    finished children, which need this node's least member."""

    __slots__ = ("size", "n", "least", "children", "leaves", "saved", "ids", "waiting", "places")

    def __init__(self, size: int):
        self.size, self.n, self.least, self.children, self.leaves, self.saved = size, 0, None, 0, 0, 0
        self.ids, self.waiting, self.places = [], [], []

    def member(self, conv_id: int | None) -> None:
        if conv_id is not None and (self.least is None or conv_id < self.least):
            self.least = conv_id

    def row(self, depth: int, ends: str | None) -> tuple:
        """NODE's columns, but for the parent's conv_id, when all members have come."""
        return self.least, depth, None, self.n, self.children, self.leaves or 1, self.saved + (self.n - 1) * self.size, ends

    def take(self, row: tuple) -> None:
        """A finished child's figures."""
        least, _, _, n, _, leaves, saved, _ = row
        self.n += n
        self.children += 1
        self.leaves += leaves
        self.saved += saved
        self.member(least)
        self.waiting.append(row)

    def named(self) -> list[tuple]:
        """The finished children with this node's least member as their parent's."""
        return [(*r[:2], self.least, *r[3:]) for r in self.waiting]


def _joined_ids(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


class RangeTrie:
    """The open-path stack over one range's merged stream. done: finished nodes whose parent is known."""

    def __init__(self):
        self.stack: list[_Open] = []
        self.done: list[tuple] = []
        self.left: list[_Open] = []  # nodes of the first row's path that the stream has left, deepest first
        self.first: bytes | None = None
        self.last = b""
        self.shared = 0  # stack[: shared + 1] lies on the first row's path

    def add(self, seq: bytes, conv_id: int, lcp: int, sizes: list[int]) -> None:
        fresh = self.first is None
        if fresh:
            self.first = seq
            self.stack = [_Open(0)]
        while len(self.stack) > max(lcp, 0) + 1:
            self.leave()
        self.stack += [_Open(sizes[d]) for d in range(len(self.stack) - 1, len(seq) // WIDTH)]
        if fresh:
            self.shared = len(self.stack) - 1
        top = self.stack[-1]
        top.n += 1
        top.member(conv_id)
        top.ids.append(conv_id)
        self.last = seq

    def leave(self) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        if depth <= self.shared:
            self.left.append(node)
            self.shared = depth - 1
            return
        self.stack[-1].take(node.row(depth, hashlib.sha256(_joined_ids(node.ids)).hexdigest()))
        self.done += node.named()

    def paths(self) -> Iterator[tuple[int, int, bytes, list[_Open]]]:
        """(side, depth of the first node, sequence of the last, nodes) of the two paths that may go on in
        other ranges: 0 the first row's, 1 what the last row's has beyond it. Their figures leave each other out."""
        if self.first is not None:
            yield 0, 0, self.first, [*self.stack[: self.shared + 1], *reversed(self.left)]
            if len(self.stack) > self.shared + 1:
                yield 1, self.shared + 1, self.last, self.stack[self.shared + 1 :]


_PART = f"kind tinyint, {NODE}, number int, side int, at int, seq binary, n array<bigint>, least array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, size array<bigint>, first bigint, ids binary"
_ARROW = pa.schema(
    [("kind", pa.int8())] + [(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _COLUMNS] + [(c, pa.int32()) for c in ("number", "side", "at")] + [("seq", pa.binary())]
    + [(c, pa.list_(pa.int64())) for c in ("n", "least", "children", "leaves", "saved", "size")] + [("first", pa.int64()), ("ids", pa.binary())]
)
_NODE, _PATH, _PIECE = range(3)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _ranges(runs: DataFrame, count: int) -> DataFrame:
    """_PART rows of each of `count` ranges: finished nodes, the two open paths, ends of members on those."""
    limit = PIECE_IDS

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        held: dict[str, list] = {}
        for batch in batches:
            for name, place, lcp, conv_id, seq, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                part = held.setdefault(name, [])
                if part and part[-1][4] + 1 != place:
                    lcp = common(part[-1][0], seq)
                part.append((seq, conv_id, lcp, sizes, place))
        trie = RangeTrie()
        for seq, conv_id, lcp, sizes in LoserTree(list(held.values())):
            trie.add(seq, conv_id, lcp, sizes)
            if len(trie.done) >= 10_000:
                yield _batch([{"kind": _NODE} | dict(zip(_COLUMNS, r)) for r in trie.done])
                trie.done = []
        rows = [{"kind": _NODE} | dict(zip(_COLUMNS, r)) for r in trie.done]
        for side, start, seq, nodes in trie.paths():
            end = start + len(nodes) - 1
            rows.append({"kind": _PATH, "number": number, "side": side, "at": start, "seq": seq[: end * WIDTH]} | {c: [getattr(x, c) for x in nodes] for c in ("n", "least", "children", "leaves", "saved", "size")})
            for depth, node in enumerate(nodes, start):
                where = {"number": number, "side": side, "at": depth}
                rows += [{"kind": _NODE} | dict(zip(_COLUMNS, r)) | where for r in node.waiting]
                rows += [{"kind": _PIECE, "first": node.ids[i], "ids": _joined_ids(node.ids[i : i + limit])} | where for i in range(0, len(node.ids), limit)]
        for at in range(0, len(rows), 10_000):
            yield _batch(rows[at : at + 10_000])

    return runs.repartitionByRange(count, "seq", "conv_id").sortWithinPartitions("run", "place").mapInArrow(run, _PART)


class Seams:
    """The same stack over the ranges' open paths in order of (seq, number, side).

    done: nodes (NODE's columns, ends left null); named: (number, side, depth, least member) of every
    path's nodes.
    """

    def __init__(self):
        self.stack: list[_Open] = []
        self.done: list[tuple] = []
        self.named: list[tuple] = []
        self.last = b""

    def add(self, number: int, side: int, start: int, seq: bytes, *figures: list) -> None:
        keep = common(self.last, seq) + 1 if self.stack else 0
        while len(self.stack) > keep:
            self.leave()
        for depth, (n, least, children, leaves, saved, size) in enumerate(zip(*figures), start):
            if depth == len(self.stack):
                self.stack.append(_Open(size))
            node = self.stack[depth]
            node.n += n
            node.member(least)
            node.children += children
            node.leaves += leaves
            node.saved += saved
            node.places.append((number, side, depth))
        self.last = seq

    def leave(self) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        row = node.row(depth, None)
        if self.stack:
            self.stack[-1].take(row)
        else:
            self.done.append(row)
        self.done += node.named()
        self.named += [(*p, node.least) for p in node.places]

    def finish(self) -> None:
        while self.stack:
            self.leave()


def _seams(paths: DataFrame) -> DataFrame:
    """_PART rows: the nodes on open paths, and under number, side, at the conv_id of the node found there.

    Two rows a range come here, however many conversations there are; they are read in order by one task.
    """

    def run(batches):
        seams = Seams()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                seams.add(*row)
            yield from out(seams)
        seams.finish()
        yield from out(seams)

    def out(seams):
        rows = [{"kind": _NODE} | dict(zip(_COLUMNS, r)) for r in seams.done] + [{"kind": _PATH, "number": a, "side": b, "at": c, "conv_id": d} for a, b, c, d in seams.named]
        seams.done, seams.named = [], []
        if rows:
            yield _batch(rows)

    return paths.select("number", "side", "at", "seq", "n", "least", "children", "leaves", "saved", "size").repartition(1).sortWithinPartitions("seq", "number", "side").mapInArrow(run, _PART)


def _digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, depth, ends): a node's pieces in order of their ids through one hash."""

    def make():
        class Hashes:
            key, sha = None, None

            def __call__(self, batch):
                rows = []
                for conv_id, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
                    if self.key == (conv_id, depth):
                        self.sha.update(b"," + ids)
                    else:
                        rows += self.result()
                        self.key, self.sha = (conv_id, depth), hashlib.sha256(ids)
                return self.batch(rows) if rows else None

            def result(self):
                return [(*self.key, self.sha.hexdigest())] if self.key else []

            def batch(self, rows):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends"])

            def finish(self):
                if self.key:
                    yield self.batch(self.result())

        return Hashes()

    keyed = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return arrow_map(keyed.select("conv_id", "depth", "ids"), make, "conv_id bigint, depth bigint, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """NODE's columns for each distinct sequence of first turns of the rebuilt conversations, the root among them.

    conv_id: least member; parent_conv_id: the parent's; n_convs: members; n_children, n_leaves;
    saved_tokens: over the subtree, (members - 1) times the code points of each node's last text;
    ends_sha256: of the comma-joined ascending ids of members that end here.

    Turns are ordered by turn, null first; rows of equal turn number by the digest of role and text, so
    repeated rows are repeated turns. Null role or text is empty. Rows without conv_id belong to no
    conversation and are left out. An empty table has no nodes, not even a root. Other columns aren't
    read. conv_id and turn must be integers. Two different turns are taken as one if 128 bits of their
    SHA-256 agree.

    A conversation is one row of 24 bytes a turn: that bounds how long one may be, a few tens of
    millions of turns. Copies of one conversation are dealt over ranges by conv_id.
    """
    spark = ready(conversations.sparkSession)
    runs = written(_sorted_runs(rebuilt(conversations)), "runs")
    rows = runs.count()
    if not rows:
        discard(runs)
        return spark.createDataFrame([], NODE)
    count = max(1, -(-rows // RANGE_ROWS), min(spark.sparkContext.defaultParallelism, rows // 512))
    parts = written(_ranges(runs, count), "trie")
    discard(runs)
    seams = written(_seams(parts.where(f"kind = {_PATH}")), "seams")
    at = ["number", "side", "at"]
    nodes = parts.where(f"kind = {_NODE}").select(*_COLUMNS, *at)
    found = seams.where(f"kind = {_PATH}").select(*at, F.col("conv_id").alias("found"))  # 2 x ranges x depth rows: Spark broadcasts it if its threshold allows
    under = nodes.where("number is not null").join(found, at).withColumn("parent_conv_id", F.col("found")).select(*_COLUMNS)
    pieces = parts.where(f"kind = {_PIECE}").select(*at, "first", "ids").join(found, at).select(F.col("found").alias("conv_id"), F.col("at").cast("bigint").alias("depth"), "first", "ids")
    open_nodes = seams.where(f"kind = {_NODE}").select(*_COLUMNS).join(_digests(pieces), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_EMPTY))).select(*_COLUMNS)
    return nodes.where("number is null").select(*_COLUMNS).unionByName(under).unionByName(open_nodes)


#: The same in DuckDB SQL, over all prefixes; crc32 is reckoned bit by bit. It takes conv_ids and turns as given once.
ORACLE = r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
own AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
kept AS (SELECT c, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c AS VARCHAR), ''), lambda x: cast(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc_table),
whole AS MATERIALIZED (SELECT k.c, list_concat(coalesce(b.turns[1:k.h], []), k.turns[k.h + 1:]) AS s FROM kept k LEFT JOIN own b ON b.c = k.c - k.c % 100),
prefixes AS (SELECT c, len(s) AS full_depth, unnest(range(0, len(s) + 1)) AS depth, s FROM whole),
nodes AS MATERIALIZED (SELECT md5(cast(s[1:depth] AS VARCHAR)) AS k, any_value(CASE WHEN depth > 0 THEN md5(cast(s[1:depth - 1] AS VARCHAR)) END) AS parent, depth, min(c) AS conv_id, count(*) AS n,
  any_value(CASE WHEN depth > 0 THEN length(s[depth].text) ELSE 0 END) AS size, sha256(coalesce(string_agg(cast(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = full_depth), '')) AS ends FROM prefixes GROUP BY k, depth),
degree AS (SELECT parent AS k, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
facts AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN degree USING (k, depth)),
lines AS (SELECT DISTINCT md5(cast(s[1:depth] AS VARCHAR)) AS top, depth AS top_depth, md5(cast(s[1:d] AS VARCHAR)) AS k, d AS depth FROM (SELECT s, depth, unnest(range(depth, full_depth + 1)) AS d FROM prefixes)),
sums AS (SELECT top AS k, top_depth AS depth, cast(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, cast(sum((n - 1) * size) AS BIGINT) AS saved_tokens FROM lines JOIN facts USING (k, depth) GROUP BY ALL)
SELECT f.conv_id, cast(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, f.ends AS ends_sha256
FROM facts f JOIN sums USING (k, depth) LEFT JOIN facts p ON p.k = f.parent AND p.depth = f.depth - 1"""
