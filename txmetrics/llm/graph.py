"""Connected components of links between ids, as joins over ever fewer links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmetrics.sinks.tables import materialise


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component``, the smallest id that can be reached, for every id in ``links`` (a, b).

    Every id points to its smallest neighbour if that is smaller than itself; following the
    pointers, doubled at each step, ends at a local minimum. Links are then drawn between these
    minima and the same is done again until none is left. Each step works on a table in the
    shared folder. Nothing is collected; a hub's links are only ever grouped with partial minima.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges = materialise(edges, f"{name}-links")
    levels = []
    while not edges.isEmpty():
        up = materialise(edges.groupBy("hi").agg(F.min("lo").alias("lo")).select(F.col("hi").alias("node"), F.col("lo").alias("to")), f"{name}-up")
        while True:
            further = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            doubled = up.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            doubled = materialise(doubled, f"{name}-up")
            up = doubled.select("node", "to")
            if doubled.where("moved").isEmpty():
                break
        levels.append(up)
        left = up.select(F.col("node").alias("hi"), F.col("to").alias("x"))
        right = up.select(F.col("node").alias("lo"), F.col("to").alias("y"))
        moved = edges.join(left, "hi").join(right, "lo", "left").select("x", F.coalesce("y", "lo").alias("y"))
        edges = moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).where("hi <> lo").distinct()
        edges = materialise(edges, f"{name}-links")
    if not levels:
        kind = links.schema["a"].dataType
        return spark.createDataFrame([], "node long, component long").select(*[F.col(c).cast(kind).alias(c) for c in ("node", "component")])
    found = levels[0].select("node", F.col("to").alias("root"))
    for level in levels[1:]:
        upper = level.select(F.col("node").alias("root"), "to")
        # a root of one level is a node of the next, unless nothing smaller is linked with it
        found = found.join(upper, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(
            level.select("node", F.col("to").alias("root"))
        ).groupBy("node").agg(F.min("root").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root")
    return materialise(
        found.unionByName(roots).groupBy("node").agg(F.min("root").alias("component")), f"{name}-found"
    )
