"""Connected components of a graph that is only ever held as a distributed table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanac.operators.settle import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (``a``, ``b``): ``node``, ``root``.

    Alternating star contraction: every node's neighbours move to the least of them, until the
    edges are stars around the roots. Neighbourhoods are only aggregated, never gathered, so a node
    with very many edges is no load on one task. Each round is written, so a lost executor costs
    no earlier round.
    """
    now = settle(_ordered(edges))
    seen = _fingerprint(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select("b", F.col("m").alias("a"))
        large = _ordered(large)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("a").alias("b"), F.col("m").alias("a")).unionByName(
            least.select("b", F.col("m").alias("a"))
        )
        now = settle(_ordered(small))
        before, seen = seen, _fingerprint(now)
        if seen == before:
            break
    roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return settle(now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller node as ``a``."""
    pair = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).collect()[0])  # one row
