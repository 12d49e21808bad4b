"""Connected components of an edge table, by DataFrame joins: no links or components reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable from each vertex of (a long, b long) edges.

    Every round a vertex takes the smallest label among its neighbours and then the label of its label, so chains
    halve; each round is written to the shared folder. Minima are combined before the shuffle, and a vertex with very many
    edges is only the large side of joins that can be split.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "v"), "labels")
    written = labels
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("component").alias("near"))
        near = labels.join(near, labels.v == near.a).select("v", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        step = materialize(near, "near")
        jump = step.select(F.col("v").alias("at"), F.col("c").alias("further"))
        new = materialize(step.join(jump, step.c == jump["at"]).select("v", "old", F.least("c", "further").alias("component")), "labels")
        release(step, written)
        labels, written = new.select("v", "component"), new
        if new.where("component <> old").isEmpty():
            return labels
