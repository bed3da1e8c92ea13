"""Connected components of an edge table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbridge.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(own)


def components(edges: DataFrame) -> DataFrame:
    """(a, b), the least node b that each node a of ``edges`` (a, b) can reach; least nodes have no row.

    Alternating star contraction: the rounds grow with the logarithm of the nodes. No node's
    neighbours are gathered; the joins' hot nodes are split by the adaptive skew join. Each round is
    written to the shared folder. Rows with a null say nothing.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = cut_lineage(plain, "components")
    last = None
    while True:
        n, total = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == last or not n:
            return state
        last = (n, total)
        state = cut_lineage(_small_star(_large_star(state).distinct()).distinct(), "components")
