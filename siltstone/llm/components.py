"""Connected components of a graph given as a DataFrame of edges, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import write_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Alternates large-star and small-star steps until the edges no longer
    change.  Least neighbours are found by partial aggregation.  Edges get them
    by ``split_join``, since a hub's partition must be one that Spark can split.
    Each round is written to the shared folder, which cuts the lineage.  Repeated edges and loops do
    no harm; an edge with a null end is left out.
    """
    now = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = write_table(now, "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = split_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        now = write_table(small, "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def split_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join on a column that may hold hot values.

    The key is wrapped, so both sides are shuffled for the join alone and no
    aggregation's shuffle serves it; only then can Spark split a hot partition.
    """
    wrapped = F.struct(key)
    return left.withColumn("_k", wrapped).join(right.withColumn("_k", wrapped).drop(key), "_k").drop("_k")
