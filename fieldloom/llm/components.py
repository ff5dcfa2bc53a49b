"""Connected components of links, by joins and aggregates; the driver sees counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import discard, joined, written


def components(stars: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. stars: (node, root) links, root <= node.

    Each node first takes the least root it is tied to. Where a node is tied to several, those roots
    are linked; that much smaller graph is solved by handing on labels (neighbours' least, then the
    label of the label) until nothing changes, each round a written table. Nodes not named in
    `stars` are their own component.
    """
    ties = stars.where("node <> root").groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
    ties = written(ties, "ties", gather=True)
    edges = ties.where("size(roots) > 1").select("root", F.explode("roots").alias("b")).where("root <> b").select(F.col("root").alias("a"), "b")
    # a root may itself be tied to a smaller one
    chained = ties.select(F.explode("roots").alias("b")).distinct().join(ties.select(F.col("node").alias("b"), F.col("root").alias("a")), "b").select("a", "b")
    edges = written(edges.unionByName(chained).distinct(), "edges", gather=True)
    if edges.isEmpty():
        return ties.select("node", "root")
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both", gather=True)
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"))
    before = labels = written(labels, "labels", gather=True)
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near")).withColumnRenamed("a", "v")
        step = labels.join(near, "v").select("v", "c", F.least("c", "near").alias("n"))
        # the old label's own node hears of the smaller one too, then labels jump
        heard = step.where("n < c").groupBy(F.col("c").alias("v")).agg(F.min("n").alias("h"))
        step = step.join(heard, "v", "left").select("v", "c", F.least("n", F.coalesce("h", "n")).alias("n"))
        step = written(step, "step", gather=True)
        jumped = step.join(step.select(F.col("v").alias("n"), F.col("n").alias("far")), "n", "left").select("v", F.col("c").alias("old"), F.least("n", F.coalesce("far", "n")).alias("c"))
        jumped = written(jumped, "labels", gather=True)
        discard(step, before)
        before, labels = jumped, jumped.select("v", "c")
        if jumped.where("c < old").isEmpty():
            break
    discard(edges, both)
    named = ties.select("node", "root").unionByName(labels.select(F.col("v").alias("node"), F.col("v").alias("root")))
    named = written(named.groupBy("node").agg(F.min("root").alias("root")), "named", gather=True)
    sized = written(named.groupBy("root").agg(F.count("*").alias("n")).join(labels.select(F.col("v").alias("root"), "c"), "root", "left"), "sized", gather=True)
    return joined(named, sized, ["root"], "n", "left").select("node", F.least("root", F.coalesce("c", "root")).alias("root")).where("node <> root")
