"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of a link ``a, b``; the root is the component's smallest node.

    Each round every node offers the smallest parent among its neighbours to itself and to its own
    parent, then skips to its parent's parent, so long chains close in a logarithmic number of
    rounds. Nothing but the count of changed parents reaches the driver.
    """
    ends = stored(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    )
    parents = stored(ends.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        old = parents.select(F.col("node").alias("_n"), F.col("root").alias("_old"))
        near = (
            ends.join(parents.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("root").alias("low"))
        )
        offers = near.join(old, near.a == old._n).select(
            F.explode(F.array("a", "_old")).alias("node"), "low"
        )
        low = offers.groupBy("node").agg(F.min("low").alias("low"))
        hooked = parents.join(low, "node").select("node", F.least("root", "low").alias("root"))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = stored(
            hooked.join(above, "root")
            .select("node", F.col("top").alias("root"))
            .join(old, F.col("node") == F.col("_n"))
            .select("node", "root", (F.col("root") != F.col("_old")).alias("moved"))
        )
        parents = after.select("node", "root")
        if after.filter("moved").isEmpty():
            return parents
