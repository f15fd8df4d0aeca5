"""Connected components of a table of edges, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from tidegauge.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges(a, b); the component is its smallest node.

    Each round hangs the larger neighbours of a node under its smallest neighbour, then the smaller ones. Both are one
    aggregation with partial minima and one join, so a node with many edges never meets in one task (skewed joins are
    split). Rounds are written to the shared folder; their number grows as the logarithm of the longest chain.
    Empty edges give no rows; loops and repeated edges change nothing.
    """
    spark = edges.sparkSession
    current = written(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(spark, large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        current = written(spark, small.distinct(), "edges")
        # all stars when no parent has a parent and no node two parents
        open_ends = current.join(current.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not open_ends and not current.groupBy("a").count().where("count > 1").limit(1).count():
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
