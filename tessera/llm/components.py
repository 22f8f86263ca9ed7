"""Connected components of a distributed edge list.

Each round every node points to the neighbour of least random priority (itself included) and edges are contracted
along these pointers, which shrinks a component by a constant factor whatever its shape; long chains of ascending ids
take a few rounds. Edges stay in the cluster. A hub's edges are split by adaptive skew joins, its minimum is
pre-aggregated in each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop, save


def _rank(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each node with an edge to another; component is the least id reachable. NULL ends and loops are ignored."""
    e = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b")
    e = save(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    spark = e.sparkSession
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(_rank("b")).alias("m"))  # written as pointers before it is joined
        pointers = save(near.select(F.col("a").alias("n"), F.least(_rank("a"), F.col("m"))["id"].alias("p")), "pointers")
        left = e.join(pointers.select(F.col("n").alias("a"), F.col("p").alias("x")), "a")
        right = left.join(pointers.select(F.col("n").alias("b"), F.col("p").alias("y")), "b")
        after = save(right.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop(e)
        e = after
        steps.append(pointers)
    drop(e)
    if not steps:
        return spark.createDataFrame([], "id bigint, component bigint")
    labels = steps[0].select(F.col("n").alias("id"), F.col("p").alias("root"))  # a node keeps the pointers of every round
    for p in steps[1:]:
        labels = labels.join(p, labels["root"] == p["n"], "left").select("id", F.coalesce("p", "root").alias("root"))
    labels = save(labels, "labels")
    for p in steps:
        drop(p)
    # written, so that both sides are plain exchanges, whose hot keys adaptive joins can split
    least = save(labels.groupBy("root").agg(F.min("id").alias("component")), "least")
    return labels.join(least, "root").select("id", "component")
