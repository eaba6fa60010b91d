"""Connected components of an edge table by least labels, hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, component): the least id reachable over ``edges`` (a, b), for every id in them.

    Each round takes the least label of a label among a node and its neighbours, for the node and for
    its label (hooking), so a long chain takes rounds by the logarithm of its length, not by its length.
    Labels are written every round, so no lineage grows; the degree of a node only meets a minimum
    that combines on the map side. Loops and repeated edges are allowed, nulls are not."""
    both = edges.filter("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    for _ in range(most_rounds):
        up = labels.join(labels.select(F.col("id").alias("component"), F.col("component").alias("up")), "component")
        near = both.join(up.select(F.col("id").alias("b"), F.col("up").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        low = up.join(near, "id").select("id", "component", F.least("up", "l").alias("low"))
        offers = low.select("id", F.col("component").alias("old"), "low").unionByName(low.select(F.col("component").alias("id"), F.lit(None).cast("long").alias("old"), "low"))
        labels = written(offers.groupBy("id").agg(F.max("old").alias("old"), F.min("low").alias("component")), "labels")
        if not labels.filter("old <> component").limit(1).count():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
