"""Connected components of links between documents, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsmith.llm._store import Tables


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, component (least node reachable) for each node of ``links`` (a, b), as one of ``tables``.

    Alternates two rewritings of the links: every larger neighbour of a node is linked to the node's least
    neighbour, then every smaller one is. Links become stars in few rounds, whatever the diameter; a round moves
    links only, and least neighbours are aggregated before the shuffle, so a hub's links never meet in a task.
    The links of a round are dropped when the next ones are written.
    """
    last = Tables(links.sparkSession)
    try:
        edges = last.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        state = None
        while True:
            # A round is one plan and one write; both rewritings join links to the least neighbour of their end.
            both = edges.union(edges.select("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
            small = large.join(least, F.col("u") == F.col("w"))
            edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            now = Tables(links.sparkSession)
            edges = now.write(edges, "links-small")
            last.drop()
            last = now
            sums = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if sums == state:
                break
            state = sums
        stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        return tables.write(stars, "components")
    finally:
        last.drop()
