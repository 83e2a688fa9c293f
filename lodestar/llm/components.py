"""Connected components of an undirected graph, with links and nodes kept in DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import cut


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = _both(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node with a link; ``root`` is the smallest node of the component.

    Alternates large-star and small-star steps until the links no longer change, which takes a number of
    rounds that grows with the logarithm of the longest path. The minimum of a node's neighbours is taken by
    a grouped aggregate that is partly done before the shuffle, and the joins can be split where a hub is hot.
    Every round is written to the shared folder, so that a lost executor costs one round at most. Loops
    and repeated links are allowed; null ends are left out. No links: no rows.
    """
    now = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    seen = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = mark
    raise RuntimeError(f"components didn't settle within {max_rounds} rounds")
