"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _distinct(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return _distinct(both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these. Edges run from the larger node a to the smaller b."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    return _distinct(down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node that is reachable. The smallest node itself has no row.

    Self-links and repeated links don't matter; no links give no rows. A hub is
    summed before it is shuffled and its join is split by adaptive execution.
    Each round is written to the shared folder; links halve in depth a round.
    """
    now = stored(_distinct(edges.select("a", "b")), "links")
    seen = None
    for _ in range(rounds):
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not sums[0] or seen == sums:
            break
        seen = sums
        after = stored(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
