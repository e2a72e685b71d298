"""Connected components of a table of edges, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.sources import stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for every node of an edge ``a``-``b``.

    Every node hands its larger neighbours to its smallest one, then its smaller neighbours
    likewise; the graph turns into stars in a number of rounds that grows with the logarithm of
    its size. Each round is written to the shared folder, so a lost executor costs one round.
    """
    edges = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct()
            )
        before = now
        both = edges.select("a", "b").union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = larger.groupBy("a").agg(F.min("b").alias("m"))
        joined = larger.join(down, "a")
        edges = stage(
            joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", "m")).distinct(),
            "edges",
        )
