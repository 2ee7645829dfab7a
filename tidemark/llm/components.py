"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links (a long, b long) to (node, component), component being the least node that can be reached.

    Nodes without a link do not come up. Every round is written to the shared folder. The number of rounds grows with
    the logarithm of a component's size; no round holds more rows than there are links and nodes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x"), F.count_if(F.col("a") <= F.col("b")).alias("bad")).first()
        if mark == (now["n"], now["x"]):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = (now["n"], now["x"])
