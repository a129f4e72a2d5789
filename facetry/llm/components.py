"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release, sweep, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a long, b long): component is the smallest node it reaches.

    Alternating stars: each node's larger neighbours, then its smaller ones, are hung on its smallest neighbour, until
    every node hangs on the smallest of its component. Rounds grow with the logarithm of the longest chain; each is
    written to the shared folder. Links with a null end, and of a node with itself, are left out.
    """
    at = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        both = at.union(at.select("b", "a"))
        # Written first, so that the join can split the partition of a node with very many neighbours.
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        after = written(hung.distinct(), "links")
        release(at, least)
        at = after
        state = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        sweep(at.sparkSession)
        if state == seen:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
