"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every end of an edge (u, v); label is the smallest node that links reach.

    A round takes the smallest label among a node's neighbours, then the label of its label, so
    a chain's length halves each round. Each round is written to the shared folder.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = scratch.stash(both, f"{name}-edges")
    labels = scratch.stash(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).select("node", F.least("node", "label").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ends = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        step = step.join(ends, "label").select("node", F.least("label", "end").alias("label"), (F.least("label", "end") < F.col("old")).alias("moved"))
        new = scratch.stash(step, f"{name}-{turn}")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("node", "label")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels
