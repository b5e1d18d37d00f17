"""Connected components of a table of edges, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.storage import dropped
from rasterloom.llm.common import join_hot, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component``: the least node that each node of an edge can reach.

    Each round takes the least label of a node and its neighbours, then follows labels one step
    further (pointer jumping), so the rounds grow with the logarithm of the longest path. Labels are
    written to the shared folder after each round. A node with very many edges, and a label with very
    many nodes, spread over all tasks. Null ends are left out; loops and repeated edges do no harm;
    no edges give no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    first = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label"), F.count(F.lit(1)).alias("degree"))
    labels = held = stored(first, "labels")
    while True:
        of = labels.select(F.col("node").alias("v"), "label", "degree")
        near = join_hot(both, of, ["v"], "degree", "u").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        met = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"), "degree"), "met")
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        up = up.join(met.groupBy("label").agg(F.count(F.lit(1)).alias("many")), "label")
        new = join_hot(met, up, ["label"], "many", "node").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"), "degree")
        new = stored(new, "labels")
        still = new.where("old <> label").isEmpty()
        dropped(met, held)
        labels, held = new.select("node", "label", "degree"), new
        if still:
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))
