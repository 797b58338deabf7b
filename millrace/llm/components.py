"""Connected components of a distributed edge list by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import Table


EDGES_PER_TASK = 200_000


def components(edges: DataFrame, max_rounds: int = 100) -> Table:
    """Table (u, v): every node u that has an edge, but for the least of its component v, once. Nodes are longs.

    Every step is written out and runs in as many tasks as its edges need. The least neighbours are written before they
    are joined: they have one row per node, so the edges of a hot node can be split over tasks.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, tag: str) -> Table:
        return Table(spark, df.coalesce(tasks), tag)

    now = Table(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "edges")
    state, tasks = None, 1
    for _ in range(max_rounds):
        before, state = state, tuple(now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        tasks = max(1, state[0] // EDGES_PER_TASK)
        if state == before or not state[0]:
            return now
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m")), "least")
        large = kept(both.join(least.df, both.u == least.df.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct(), "large-star")
        low = kept(large.df.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least")
        hung = large.df.join(low.df, large.df.u == low.df.k)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.df.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct()
        after = kept(small, "small-star")
        for used in (now, least, large, low):
            used.drop()
        now = after
    raise RuntimeError("components did not settle")
