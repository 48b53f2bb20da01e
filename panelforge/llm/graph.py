"""Connected components of undirected links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links (16 bytes each) whose rounds run in one task: an exchange would take longer than the work.
FEW = 500_000


def components(links: DataFrame) -> DataFrame:
    """``node, root``: every node of ``links`` (a, b) other than its component's smallest, with that smallest node.

    Alternates large-star and small-star steps (each hangs a node's neighbours below its smallest neighbour) until the
    links are stars. Each step is one aggregation and one join on the node; a hub's rows can be split, since the side with
    its smallest neighbour has one row a node. Every round is written to the shared folder. ``FEW`` links at most are held in
    one partition, so that no round needs an exchange.
    """
    stars = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(stars)
    while mark[0]:
        one = (lambda df: df.coalesce(1)) if mark[0] <= FEW else (lambda df: df)
        stars, made = one(stars), stars
        both = one(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = one(large.join(low, "a").select(F.col("b").alias("x"), F.col("low").alias("y")).unionByName(low.select(F.col("a").alias("x"), F.col("low").alias("y"))))
        small = small.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        after = common.written(small, "links")
        common.dropped(made)
        stars, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    common.released(links.sparkSession)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """Count and checksum; equal before and after a round only if nothing changed."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
