"""Minimum-cost-flow resharding: which bytes move from old shards to new ones, and the rewrite."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from ._common import joined, written

#: Blocks all old shards together are cut into: as many as hold ROWS rows each, within bounds; the driver holds a few numbers of each.
FEWEST, MOST, ROWS = 4096, 1 << 18, 1 << 16
#: A unit over 1/LARGE of a shard's mean is placed by itself: there are at most LARGE times the shards of them.
LARGE = 64
#: Equal texts that take over 1/WHOLE of a shard's mean, or 1/FEWEST of all rows and over ROWS, are placed row by row.
WHOLE = 4
#: Bytes of a file that rewrite() writes, about.
FILE = 256 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Units i -> j that ship all supply within capacity at the least total cost(i, j) per unit.

    Successive shortest paths over source, old shards, new shards and sink, by Bellman-Ford on the
    residual graph; whole bottlenecks are pushed, so the rounds depend on the shards, not the bytes.
    """
    a, b = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("more supply than capacity")
    source, sink = a + b, a + b + 1
    edges: list[list[int]] = []  # to, residual, cost; the reverse is at index ^ 1
    out: list[list[int]] = [[] for _ in range(a + b + 2)]

    def add(u: int, v: int, cap: int, c: int) -> None:
        for x, y, r, k in ((u, v, cap, c), (v, u, 0, -c)):
            out[x].append(len(edges))
            edges.append([y, r, k])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for j, c in enumerate(capacity):
        add(a + j, sink, c, 0)
    first = len(edges)
    for i in range(a):
        for j in range(b):
            add(i, a + j, supply[i], cost(i, j))
    while True:
        dist, via = {source: 0}, {}
        queue = [source]
        while queue:
            nxt = []
            for u in queue:
                for e in out[u]:
                    v, r, c = edges[e]
                    if r > 0 and dist[u] + c < dist.get(v, 1 << 62):
                        dist[v], via[v] = dist[u] + c, e
                        nxt.append(v)
            queue = list(dict.fromkeys(nxt))
        if sink not in dist:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    flow = {}
    for n in range(first, len(edges), 2):
        if edges[n ^ 1][1]:
            i, j = divmod((n - first) // 2, b)
            flow[i, j] = edges[n ^ 1][1]
    return flow


def equal_parts(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", cost=lambda i, j: int(i != j)) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved[, carry]) of every row; law `bytes`.

    Old shard i goes on as new shard i; the new capacities are equal parts of all bytes. The flow
    between old sizes and capacities says how many bytes move from where to where; it is solved on
    the driver over at most n_old x n_new numbers.

    Equal texts stay together: they are one unit, at home in the old shard that has most of them. Those
    that take over 1/WHOLE of a shard, or 1/FEWEST of all rows, are split: each row is its own unit.
    Units lie in blocks by hash; blocks are laid end to end in each old shard and cut where the flow
    says, so whole blocks go over and only the blocks at a cut are split, between units. Units larger
    than 1/LARGE of a capacity (their number is bounded by that) are placed first, each by itself: at
    home if there is room, else where most room is. So a shard is off its capacity by a few such parts
    at most. Slots are ranks in the block plus the rows of the shard's earlier blocks: no shard is ever
    sorted as a whole.

    Null and empty texts have size 8 and crc 0, and are equal. Rows with null or repeated ids stay,
    each with a place; equal rows can swap places. An empty table gives no rows. Columns not named
    are not read; those of `carry` should be narrow.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
            F.xxhash64(text).alias("g"),
            F.monotonically_increasing_id().alias("rid"),
            *carry,
        ),
        "reshard",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_blocks = max(1, min(MOST, max(FEWEST, count // ROWS)) // n_old)
    capacity = equal_parts(total, n_new)
    limit, most = max(1, total // (n_new * LARGE)), max(1, total // (n_new * WHOLE))
    groups = rows.groupBy("g", "size").agg(F.count("*").alias("n"), F.mode("old_shard", deterministic=True).alias("home"), (F.min("old_shard") != F.max("old_shard")).alias("apart"))
    groups = written(groups.where("n > 1"), "groups")
    split = (F.col("n") * F.col("size") > most) | (F.col("n") > max(ROWS, count // FEWEST))
    # at most WHOLE times the shards of the one kind, FEWEST of the other
    rows = rows.join(F.broadcast(groups.where(split).select("g", "size", F.lit(True).alias("split"))), ["g", "size"], "left")
    rows = joined(rows, groups.where(~split & F.col("apart")).select("g", "size", "home", "n"), ["g", "size"], "n", "left")
    rows = rows.withColumn("u", F.when(F.col("split"), F.xxhash64("rid", F.lit(1))).otherwise(F.xxhash64("g", "size"))).withColumn("home", F.coalesce("home", "old_shard"))
    rows = written(rows.drop("g", "split").withColumn("block", F.pmod("u", F.lit(n_blocks)).cast("int")), "reshard")
    units = written(rows.groupBy("home", "block", "u").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "units")
    # each large unit has over total / (n_new * LARGE) bytes: fewer than n_new * LARGE of them
    large = units.where(F.col("bytes") > limit).collect()
    room, own = list(capacity), []
    for r in sorted(large, key=lambda r: (-r["bytes"], r["home"], r["u"])):
        j = r["home"] if r["home"] < n_new and room[r["home"]] >= r["bytes"] else max(range(n_new), key=lambda j: (room[j], -j))
        room[j] -= r["bytes"]
        own.append((r["home"], r["u"], r["n"], j))
    stats = {(r["home"], r["block"]): r["bytes"] for r in units.where(F.col("bytes") <= limit).groupBy("home", "block").agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [sum(v for (i, _), v in stats.items() if i == old) for old in range(n_old)]
    over = [max(0, x) for x in room]
    cut = sum(over) - sum(supply)  # a shard that a large unit overfills leaves less room for the rest
    for j in sorted(range(n_new), key=lambda j: -over[j]):
        if cut > 0:
            less = min(cut, over[j])
            over[j], cut = over[j] - less, cut - less
    flow = min_cost_flow(supply, over, cost)
    plan = []
    for old in range(n_old):
        at, ends, shards = 0, [], []
        for i, j in sorted(flow, key=lambda k: (k[0], k[0] != k[1], k[1])):
            if i == old:
                at += flow[i, j]
                ends.append(at)
                shards.append(j)
        at = 0
        for b in range(n_blocks):
            if size := stats.get((old, b)):
                lo, hi = bisect_right(ends, at), min(bisect_right(ends, at + size - 1), len(ends) - 1)
                plan.append((old, b, at, ends[lo : hi + 1], shards[lo : hi + 1]))
                at += size
    blocks = spark.createDataFrame(plan, "home int, block int, at bigint, ends array<bigint>, shards array<int>")
    alone = spark.createDataFrame([(home, u, j) for home, u, _, j in own], "home int, u bigint, shard int")
    within = W.partitionBy("home", "block").orderBy("u")
    # at most MOST rows, and one array element for each block and cut
    placed = (
        rows.join(F.broadcast(alone), ["home", "u"], "left_anti")
        .withColumn("rn", F.row_number().over(W.partitionBy("home", "block").orderBy("u", "doc_id", "rid")))
        .withColumn("upto", F.sum("size").over(within.rangeBetween(W.unboundedPreceding, W.currentRow)))  # to the unit's end
        .withColumn("unit", F.sum("size").over(W.partitionBy("home", "block", "u")))
        .join(F.broadcast(blocks), ["home", "block"])
        .withColumn("mid", F.col("at") + F.col("upto") - F.expr("unit div 2") - 1)
        .withColumn("shard", F.expr("shards[cast(least(size(filter(ends, e -> e <= mid)), size(shards) - 1) as int)]"))
    )
    placed = written(placed.drop("upto", "unit", "at", "ends", "shards", "mid"), "placed")
    pieces = defaultdict(list)
    for r in placed.groupBy("shard", "home", "block").agg(F.count("*").alias("n"), F.min("rn").alias("low")).collect():
        pieces[r["shard"]].append((r["home"], r["block"], r["n"], r["low"]))
    bases, filled = [], defaultdict(int)
    for shard, found in pieces.items():
        for home, block, n, low in sorted(found):
            bases.append((shard, home, block, filled[shard] - low))
            filled[shard] += n
    first = []
    for home, u, n, j in own:
        first.append((home, u, j, filled[j] - 1))
        filled[j] += n
    base = F.broadcast(spark.createDataFrame(bases, "shard int, home int, block int, base bigint"))  # blocks and cuts
    few = rows.join(F.broadcast(spark.createDataFrame(first, "home int, u bigint, shard int, base bigint")), ["home", "u"])
    few = few.withColumn("rn", F.row_number().over(W.partitionBy("home", "u").orderBy("doc_id", "rid")))
    out = lambda df: df.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rn")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "old_shard", (F.col("shard") != F.col("old_shard")).alias("moved"), *carry,
    )
    return out(placed.join(base, ["shard", "home", "block"])).unionByName(out(few))


def hashed_layout(n_old: int, id_col: str = "doc_id") -> Column:
    """The layout before: the id's hash over n_old shards."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_old)).cast("int")


def rewrite(spark: SparkSession, old_root: str, new_root: str, n_old: int, n_new: int) -> list[int]:
    """Reads shards old_root/shard=i, writes to new_root/shard=j the shards whose rows change; those numbers.

    Shards that neither lose nor gain rows are not written: their files hold as they are. A shard is
    written by many tasks, each a range of its slots, as files of about FILE bytes in the order of slots.
    Null ids and texts, repeated rows and other columns are written as they were; a column `slot`, as an
    earlier rewrite left it, is replaced. A folder whose tables are empty gives no shards and writes nothing.
    """
    docs = spark.read.parquet(old_root)
    columns = [c for c in docs.columns if c not in ("doc_id", "shard", "slot")]
    named = docs.select("doc_id", "shard", *(F.col(f"`{c}`").alias(f"c_{c}") for c in columns)).withColumn("key", F.monotonically_increasing_id())
    named = written(named, "reshard-rows")  # the keys stay
    plan = written(reshard(named, F.col("shard"), n_old, n_new, carry=("key",), text_col="c_text"), "reshard-plan")
    moved = plan.where("moved").groupBy("old_shard", "shard").count().collect()  # old x new rows at most
    touched = sorted({r["shard"] for r in moved} | {r["old_shard"] for r in moved if r["old_shard"] < n_new})
    if not touched:
        return []
    places = plan.where(F.col("shard").isin(touched)).select("key", "shard", "slot", "size")
    files = max(len(touched), -(-(places.agg(F.sum("size")).first()[0] or 0) // FILE))
    rows = named.drop("shard").join(places.drop("size"), "key").select("shard", "slot", "doc_id", *(F.col(f"`c_{c}`").alias(c) for c in columns))
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(new_root)
    return touched
