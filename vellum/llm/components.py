"""Connected components by alternating large-star and small-star, with every step as a written table.

Large-star links each neighbour larger than a node to the smallest one around it, small-star links the smaller neighbours
and the node itself. Both keep components together; when a round of both changes nothing, every node hangs on the smallest of
its component. Rounds grow with the logarithm of the longest path, and no task holds the neighbours of a node.
"""

from pyspark.sql import DataFrame, functions as F

from vellum import session


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    linked = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links between numbers (columns a and b): node, component (its smallest node). Nodes without a link are not listed.

    Links may be repeated, given either way round, or tie a node to itself; links with a null are left out.
    """
    links = links.where("a is not null and b is not null and a != b")
    edges = session.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(edges)
    while True:
        edges = session.written(small_star(large_star(edges)), "stars")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
