"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Table, write


def components(edges: DataFrame, a: str = "a", b: str = "b") -> Table:
    """(id, component) of every node of an edge: component is the smallest node that it is connected with, itself included.

    Alternating large-star and small-star steps, each a groupBy with partial sums and a join, until no edge changes. Each
    step's edges are a written table, so no lineage grows, lost executors cost one step, and the planner knows the size
    of what it joins: a small table is broadcast, a large one is shuffled, and a node with very many edges is split by
    adaptive execution. The number of steps grows with the logarithm of the number of nodes. Null ends and loops are
    ignored; repeated edges count once; no edges: an empty table.
    """
    one = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u is not null and u <> v").distinct()
    now = write(one, "edges")  # u < v
    while True:
        # large star: every larger neighbour of a node is linked with the node's smallest neighbour (itself included)
        both = now.df.unionAll(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = write(both.filter("v > u").join(low.df, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct(), "large")
        low.drop()
        # small star: every smaller neighbour of a node, and the node itself, is linked with the smallest of them
        low = write(large.df.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.df.join(low.df, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new = write(small, "edges")
        large.drop()
        low.drop()
        # done when each node hangs on one root only and no root hangs on anything
        done = new.df.groupBy("v").agg(F.min("u").alias("u"), F.count("*").alias("n"))
        loose = done.filter("n > 1").limit(1).count() or new.df.select("u").distinct().join(new.df.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        now.drop()
        now = new
        if not loose:
            break
    result = write(now.df.select(F.col("v").alias("id"), F.col("u").alias("component")).unionAll(now.df.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()), "components")
    now.drop()
    return result
