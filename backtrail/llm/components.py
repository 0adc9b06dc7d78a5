"""Connected components of a link table, without bringing links to the driver.

Alternates two steps until the links stop changing. Large star: every node ties its larger neighbours to the smallest
node it knows. Small star: every node ties its smaller neighbours and itself to the smallest of them. Both keep the
components, and end with each node tied directly to the smallest node of its component, in about log2 of the longest
path's length rounds. The minimum of a node's neighbours is pre-aggregated before the shuffle, and the join that hands it
back is a plain equi-join whose skewed partitions Spark splits, so a node with very many links is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node in links (a, b); component is the smallest node reachable, itself included."""
    links = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )  # a > b
    state = _state(links)
    while True:
        links = materialise(_small_star(materialise(_large_star(links), "large")), "small")
        now = _state(links)
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = now


def _state(links: DataFrame) -> tuple:
    """Count and order-free digest of the links."""
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a's neighbour b
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    # u's larger neighbours are the a of the links (a, u)
    return links.join(materialise(least, "least"), F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = materialise(links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
    tied = links.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
