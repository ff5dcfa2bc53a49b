"""Pivot-permutation index for embedding near-duplicates.

Each vector is described by its nearest pivots, in order. It is posted in the lists of its first
ROUTE pivots, one set of lists a label and dimension; candidates of a vector are those it meets in a
list, ranked by how many of their first PREFIX pivots they share; those with at least SHARED are
verified by cosine in double precision.

A list of over SPLIT vectors is split by a second pivot of their prefixes, then by a third: two vectors
that share SHARED pivots share these too, so no candidate is lost.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ._common import arrow_map, discard, joined, written
from .components import components

PREFIX, ROUTE, SHARED = 10, 5, 3
#: Vectors a posting list is meant to hold, pivots grow with the vectors so that it stays so; and those above which it is split.
LIST, SPLIT = 256, 2048
#: Pivots at least and at most, and the bounded sample they are drawn from; dimensions that have their own sample.
FEWEST, MOST, SAMPLE, SAMPLED = 64, 1024, 8192, 8
#: Cosine above which two pivots are too much alike.
APART = 0.7
#: Lists are compared block against block, of so many vectors at least and at most; in between a block
#: grows as STRETCH times the root of its list, so that copies for blocks stay few.
BLOCK, LARGEST, STRETCH = 256, 16384, 8
#: Bytes that a block's components take as doubles, at most: many dimensions make smaller blocks.
BLOCK_BYTES = 64 << 20


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)  # squares of the largest and least numbers stay finite
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


@lru_cache(64)
def scattered(dimension: int) -> np.ndarray:
    """Pivots for dimensions without a sample: the same FEWEST directions in every task."""
    return unit(np.random.default_rng(dimension).normal(size=(FEWEST, dimension)))


def choose(sample: np.ndarray, count: int) -> np.ndarray:
    """Spread pivots: each next one is the sample vector least like those chosen so far.

    It ends early where none is left under APART: pivots that near each other would be ordered by
    noise alone.
    """
    chosen = [0]
    best = sample @ sample[0]
    while len(chosen) < count:
        i = int(best.argmin())
        if best[i] > APART:
            break
        chosen.append(i)
        best = np.maximum(best, sample @ sample[i])
    return sample[chosen]


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first; ties by number."""
    near = x @ pivots.T
    k = min(prefix, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.lexsort((top, -np.take_along_axis(near, top, 1)), axis=1)
    return np.take_along_axis(top, order, 1).astype(np.int32)


def shared(a: np.ndarray, b: np.ndarray, pivots: int) -> np.ndarray:
    """How many pivots each row of a has in common with each row of b."""
    marks = []
    for p in (a, b):
        m = np.zeros((len(p), pivots), np.float32)
        np.put_along_axis(m, p.astype(np.int64), 1, 1)
        marks.append(m)
    return marks[0] @ marks[1].T


def _compare(left, right, same: bool, key: tuple[int, int, int], threshold: float, least: int, route: int):
    """Links between two blocks of one posting list: candidates by shared-pivot counts, then cosines.

    A pair counts in one list only: by the first pivot by number that both are posted by, and, where
    the list was split, the first and second of the others they share. Yields blocks of (rows of left,
    rows of right)."""
    used, back = np.unique(np.concatenate([left["p"].ravel(), right["p"].ravel()]), return_inverse=True)
    p, q = back[: left["p"].size].reshape(left["p"].shape), back[left["p"].size :].reshape(right["p"].shape)
    here, second, third = (int(np.searchsorted(used, k)) if k >= 0 else -1 for k in key)
    none = len(used)
    for a in range(0, len(p), 256):
        i, j = np.nonzero(shared(p[a : a + 256], q, none) >= least)
        i += a
        if same:
            i, j = i[j > i], j[j > i]
        for b in range(0, len(i), 65536):
            u, v = i[b : b + 65536], j[b : b + 65536]
            keep = np.einsum("ij,ij->i", left["x"][u], right["x"][v]) >= threshold
            u, v = u[keep], v[keep]
            keep = np.where((p[u, :route, None] == q[v, None, :route]).any(2), p[u, :route], none).min(1) == here if len(u) else keep[:0]
            if second >= 0 and len(u):
                others = np.sort(np.where((p[u, :, None] == q[v, None, :]).any(2) & (p[u] != here), p[u], none), axis=1)
                keep &= others[:, 0] == second
                if third >= 0:
                    keep &= others[:, 1] == third
            yield u[keep], v[keep]


def unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of u[k] and v[k]; in parent, flat before and after, each index has its tree's least."""
    while len(u):
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        apart = low != high
        u, v = u[apart], v[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _frame(table: pd.DataFrame) -> dict[str, np.ndarray]:
    return {"id": table["vec_id"].to_numpy(np.int64), "n": table["copies"].to_numpy(np.int64), "x": unit(np.stack(table["embedding"].to_numpy())), "p": np.stack(table["pivots"].to_numpy()).astype(np.int64)}


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of one label and dimension link at cosine >= threshold, in double precision. Equal vectors
    of a label are one entry of the index and count by their copies. The pivots are drawn from SAMPLE
    vectors in hash order, for the SAMPLED commonest dimensions; others have pivots of their own that
    need no sample. Every vector is indexed. Lists are split, then compared block against block, in many
    tasks. Tasks hand back sums, and ties to the least id that their links reach, never pairs.

    Lists carry ids and pivots; the vectors are joined to block pairs last. A task holds two blocks, each of
    LARGEST vectors and BLOCK_BYTES at most.

    Null label; null, empty or zero vector; a null or non-finite component: linked with nothing, its
    own component. Null id: the same, component null. Repeated rows link as vectors do. An empty
    table gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.coalesce(sound, F.lit(False)))
    distinct = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    # lists and blocks name a vector by its id and hash: rows of one id may hold several vectors
    distinct = written(distinct.withColumn("vec", F.xxhash64("label", "embedding")), "vectors")
    labels = distinct.select("label").distinct().count()
    everyone = vectors.select(F.col(id_col).alias("vec_id"))
    if not labels:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    tables = {}
    for d, n in distinct.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(SAMPLED).collect():
        sample = distinct.where(F.size("embedding") == d).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        sample = sample.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        tables[d] = choose(unit(sample), min(MOST, max(FEWEST, math.ceil(n * ROUTE / (LIST * labels)))))
    shared_tables = spark.sparkContext.broadcast(tables)  # SAMPLED times MOST pivots at most

    def make():
        def one(batch: pa.RecordBatch):
            size = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                rows = batch.filter(pa.array(size == d))
                x = unit(np.stack(rows.column(2).to_numpy(zero_copy_only=False)))
                perm = permutations(x, shared_tables.value[d] if d in shared_tables.value else scattered(d), PREFIX)
                route = min(ROUTE, perm.shape[1])
                at = pa.array(np.repeat(np.arange(len(x)), route))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(at), rows.column(1).take(at), rows.column(3).take(at), rows.column(4).take(at), pa.array(perm.tolist(), pa.list_(pa.int32())).take(at), pa.array(np.full(len(at), d), pa.int32()), pa.array(perm[:, :route].ravel(), pa.int32())],
                    names=["label", "vec_id", "copies", "vec", "pivots", "dim", "pivot"],
                )

        return one

    label_type = distinct.schema["label"].dataType.simpleString()
    posted = arrow_map(distinct.select("label", "vec_id", "embedding", "copies", "vec"), make, f"label {label_type}, vec_id bigint, copies bigint, vec bigint, pivots array<int>, dim int, pivot int")
    posted = written(posted.withColumn("second", F.lit(-1)).withColumn("third", F.lit(-1)), "posted")
    keys = ["label", "dim", "pivot", "second", "third"]
    parts, old = [], [posted]
    for split in ("second", "third", None):
        sizes = written(posted.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("size", F.col("n")), "lists")
        sized = joined(posted, sizes, keys, "n")
        old.append(sizes)
        if split is None or sizes.where(F.col("size") > SPLIT).isEmpty():
            parts.append(sized)
            break
        # a list of vectors with fewer than SHARED pivots cannot be split
        whole = (F.col("size") <= SPLIT) | (F.size("pivots") < SHARED)
        parts.append(sized.where(whole))
        other = F.filter("pivots", (lambda x: x != F.col("pivot")) if split == "second" else (lambda x: (x != F.col("pivot")) & (x > F.col("second"))))
        posted = written(sized.where(~whole).drop("size").withColumn(split, F.explode(other)), "posted")
        old.append(posted)
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    most = F.least(F.lit(float(LARGEST)), F.greatest(F.lit(1.0), F.floor(BLOCK_BYTES / (8 * F.col("dim")))))
    blocks = lists.withColumn("blocks", F.ceil(F.col("size") / F.least(most, F.greatest(F.lit(float(BLOCK)), STRETCH * F.sqrt("size")))).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # block pairs (i, j), i <= j: a block meets each block once
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    blocks = blocks.withColumn("pair", F.explode(pair)).select(*keys, "vec_id", "vec", "copies", "pivots", "block", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
    # a vector itself comes in last, once for each block pair; until here its copies are narrow
    blocks = blocks.join(distinct.select("vec_id", "vec", "embedding"), ["vec_id", "vec"]).drop("vec")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, *key = (int(pdf[c].iloc[0]) for c in ("i", "j", "pivot", "second", "third"))
        left = _frame(pdf[pdf["block"] == i])
        other = pdf if i == j else pdf[pdf["block"] == j]
        if not len(other) or not len(left["id"]):
            return pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")
        right = left if i == j else _frame(other)
        ids = np.concatenate([left["id"], right["id"]]) if i != j else left["id"]
        shift = len(left["id"]) if i != j else 0
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        least = min(SHARED, left["p"].shape[1])
        for a, b in _compare(left, right, i == j, tuple(key), threshold, least, ROUTE):
            np.add.at(links, a, right["n"][b])
            np.add.at(links, b + shift, left["n"][a])
            unite(parent, a, b + shift)
        least_id = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least_id, parent, ids)
        keep = links > 0
        return pd.DataFrame({"vec_id": ids[keep], "links": links[keep], "root": least_id[parent][keep]})

    found = blocks.groupBy(*keys, "i", "j").applyInPandas(compare, "vec_id bigint, links bigint, root bigint")
    found = written(found, "links")
    discard(*old)
    roots = components(found.select(F.col("vec_id").alias("node"), "root"))
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    entry = distinct.join(sums, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    entry = written(entry.select("label", "embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")), "entries")
    linked = joined(good.select("vec_id", "label", "embedding"), entry, ["label", "embedding"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
