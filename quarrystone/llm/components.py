"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, saved


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, comp) for every node of the links (a, b): ``comp`` is the component's smallest node.

    Each round every node hands its larger neighbours, then its smaller ones, to the smallest of them; after a number of rounds
    that grows with the logarithm of the size all nodes of a component hang on the smallest one. A link needs two long
    values a round, and what a node gathers is added up before it is shuffled; adaptive execution splits the links of hub nodes.
    Links that aren't settled after ``rounds`` rounds, a limit far beyond any logarithm, raise an error.
    """
    e = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(m, "u")
        small = hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        after = saved(small, "links")
        drop(e)
        e = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
