"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round replaces links by links to smaller neighbours with grouped minima and
joins; the table of links is written to the shared folder after each round, so the
lineage stays short and nothing but a count and a checksum reaches the driver. A
hub is a hot key only in grouped minima (combined before the shuffle) and in a
join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m"))
    return (sym.join(low.hint("merge"), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where(F.col("u") != F.col("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low.hint("merge"), "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every node of the undirected links ``(u long, v long)``.

    ``root`` is the smallest node reachable; a node without a link to another does
    not appear. Self links and repeated links are ignored, links with a null end
    too. Raises if ``max_rounds`` do not suffice (the rounds needed grow with the
    logarithm of the number of nodes).
    """
    e = cut(links.select("u", "v").where("u != v").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError("components: no fixed point within max_rounds")
