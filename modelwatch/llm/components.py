"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: More rounds than any graph of this kind needs; each round at least halves the longest chain of stars.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Large and small stars in turn: first every node hands its larger neighbours to its smallest
    one, then its smaller neighbours. Every step is written to the shared folder and read back, so no lineage
    grows and a lost executor costs one step. Nothing is collected but counts. A hub's rows are only
    looked up against one row a node, a join whose large partitions Spark splits.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "low")
        large = stored(edges.join(low, edges["b"] == low["n"])  # a > b, so b hands a to its smallest
                       .where("a <> m").select("a", F.col("m").alias("b")).distinct(), "large")
        # large stars keep a > b; each node now hands its smaller neighbours to its smallest one
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "least")
        small = (large.join(least, large["a"] == least["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))))
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")
