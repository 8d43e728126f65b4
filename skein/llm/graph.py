"""Connected components of a link table, by alternating stars, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of its component.

    Each round hangs every node's larger neighbours on the smallest one, then every node's
    smaller neighbours; a table of stars is the fixed point. Rows never exceed the links.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where(F.col("v") != F.col("m")).distinct(), "links")
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("w") > F.col("u")).join(least, "u").select(F.col("w").alias("v"), "m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        met = large.join(least, "v")
        small = met.select("v", F.col("least").alias("m")).unionByName(met.where(F.col("m") != F.col("least")).select(F.col("m").alias("v"), F.col("least").alias("m")))
        edges = materialize(small.distinct(), "stars")
        twice = edges.groupBy("v").count().where("count > 1")
        chained = edges.join(edges.select(F.col("v").alias("m")).distinct(), "m", "left_semi")
        if twice.isEmpty() and chained.isEmpty():
            break
    return edges.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(edges.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
