"""Connected components by contraction, without collecting edges or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every end of ``edges`` (two long columns); root is the smallest node of the component.

    Each round sends every node to its smallest neighbour, follows these steps
    to their ends (the distance doubles each time), and contracts the edges.
    In two rounds every node that is left has taken in another one or gone
    into one, so rounds and doublings grow with the logarithm of the
    component. Minima are combined before the shuffle. In the joins a node to
    which very many others point is one key of the long side, which adaptive
    execution splits (both sides are read from tables, so it can).
    """

    def normal(df: DataFrame, x, y) -> DataFrame:
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()

    left = settled(normal(edges, F.col(a), F.col(b)))
    nodes = None
    while True:
        if left.isEmpty():
            break
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        step = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        step = settled(step)
        moving = True
        while moving:
            further = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = settled(merged(step, further, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            moving = not step.filter("moved").isEmpty()
        step = step.select("node", F.col("to").alias("root"))
        if nodes is None:
            nodes = step
        else:
            nodes = settled(merged(nodes, step.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        for end in ("a", "b"):
            left = merged(left, step.select(F.col("node").alias(end), F.col("root").alias("to")), end).drop(end).withColumnRenamed("to", end)
        left = settled(normal(left, F.col("a"), F.col("b")))
    if nodes is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes
