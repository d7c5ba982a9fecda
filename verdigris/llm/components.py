"""Connected components by alternating large-star and small-star rounds, every round a table in the shared folder.

Stars hook onto minima, so the number of rounds is about the logarithm of the largest component. A hub's rows meet
in joins on its id, which AQE can split; minima are summed up before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long); root is the component's smallest node, root < node."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while (now := _digest(edges)) != before and now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        before, old = now, edges
        edges = materialize(small, "edges")
        discard(old, large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: the same twice means that all are stars."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
