"""Connected components of a set of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b of one type that has an order) that isn't its own label; the label is the component's
    smallest node. Each step's links are written to the shared folder; the number of steps grows with the logarithm of
    the largest component. A node with very many links meets a single row of least neighbours, so skewed joins split."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = checkpoint(links)
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # written, so that the joins are of plain exchanges, whose large partitions Spark splits
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpoint(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        low = checkpoint(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x"))
        links = checkpoint(small.select("x.*").where("hi <> lo").distinct())
        # done when nobody's label has a smaller one itself, which also leaves each node one label
        if links.join(links.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
