"""Connected components of a graph given as a table of edges.

Alternating large and small stars: every step replaces edges by edges to smaller nodes until
all nodes of a component hang on its smallest.  A step is an aggregate with a partial part
and an equi-join that adaptive execution can split, so a node with very many edges is not
one task's.  Edges are written after each round; only two numbers reach the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcensus.llm.tables import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    ways = _both_ways(edges)
    least = ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        ways.filter("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges`` (``a, b``, no nulls): label is the
    smallest node of its component."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
        edges = written(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b"), F.col("b")).distinct()
    )
