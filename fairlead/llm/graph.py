"""Connected components of a table of links, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import stored_table


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b): the smallest node that it is connected to, itself included.

    Large-star and small-star in turn: every link first moves its lower end to the smallest node known below it, then
    the links of a node are hung below the smallest of their lower ends. Both steps keep what is connected, never add
    a link, and roots are linked to each other, so the rounds grow with the logarithm of the longest path (11 for a
    shuffled path of 5,000 nodes). It ends when every link leads to a root. Minima are combined before they are
    exchanged, and each round ends in a written table. Self links, repeated links and either order are allowed; rows
    with a null end are ignored. No links give no rows.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = ends.select("a").union(ends.select("b")).distinct().select(F.col("a").alias("node"))
    stars = ends.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    stars = stored_table(stars, "links")
    while True:
        root = stars.groupBy(F.col("high").alias("at")).agg(F.min("low").alias("root"))
        lifted = stars.join(root, F.col("low") == F.col("at"), "left").select("high", F.coalesce("root", "low").alias("low"), F.col("root").isNotNull().alias("moved"))
        least = lifted.groupBy(F.col("high").alias("at")).agg(F.min("low").alias("least"))
        hung = lifted.join(least, F.col("high") == F.col("at")).withColumn("open", F.col("moved") | (F.col("low") != F.col("least")))
        hung = hung.select(F.explode(F.array(F.col("high"), F.col("low"))).alias("high"), F.col("least").alias("low"), "open").where("high <> low")
        hung = stored_table(hung.groupBy("high", "low").agg(F.max("open").alias("open")), "links")
        stars = hung.select("high", "low")
        if not hung.where("open").limit(1).count():
            return nodes.join(stars, F.col("node") == F.col("high"), "left").select("node", F.coalesce("low", "node").alias("label"))
