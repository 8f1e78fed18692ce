"""Connected components of a link table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.tables import fixed


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star (``both``): every larger neighbour of a node is linked to the smallest of node and neighbours.

    Small star: the same for the node and its smaller neighbours. Sums per node are made before the shuffle.
    """
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")) if both else None
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    near = back if around is None else back.unionByName(around)
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    if both:
        out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): each linked node with the smallest node of its component. ``links`` has columns a and b.

    The number of steps grows with the logarithm of the longest chain. Each step ends in a written table.
    """
    edges = fixed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        edges = fixed(_star(_star(edges, True), False))
    # Every edge now leads to the smallest node of its component.
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("label"))
    ).distinct()
