"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each vertex of the edges (u, v) the least vertex of its component.

    Each round takes the least label among a vertex and its neighbours, then follows that
    label's own label, so paths halve; every round is written to the shared folder. Sums by
    vertex combine before the shuffle, so a hub with very many edges is no hot key there.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "v"), "labels")
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("v") == F.col("u")).select("v", F.col("label").alias("old"),
                                                                   F.least("label", "near").alias("label"))
        root = labels.select(F.col("v").alias("r"), F.col("label").alias("root"))
        new = stored(least.join(root, F.col("label") == F.col("r")).select(
            "v", F.least("label", "root").alias("label"), (F.least("label", "root") != F.col("old")).alias("moved")), "labels")
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels
