"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import shared_table, sized


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    """Every vertex links its larger neighbours to its smallest neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sized(both.groupBy("a").agg(F.min("b").alias("m")), rows).select("a", F.least("a", "m").alias("m"))
    return sized(both.where("b > a").join(least, "a"), rows).select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .where("a != b").distinct()


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    """Every vertex links itself and its smaller neighbours to the smallest of them; ``a > b`` in ``e``."""
    least = sized(e.groupBy("a").agg(F.min("b").alias("m")), rows)
    moved = sized(e.join(least, "a"), rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``vertex, root`` for every vertex in ``links (a, b)``, a written table; ``root`` is the
    least vertex of its component. Each round is written to the shared folder, so that the
    lineage stays short; the driver only sees a row count and a checksum of each round, and
    the count sizes the next round's tasks. The number of rounds grows with the logarithm
    of the components' size."""
    rows = links.count()
    e = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before = None
    while True:
        big = sized(_large_star(e, rows), rows)
        e = shared_table(sized(_small_star(big, rows), rows), "stars")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == before:
            break
        before, rows = now, now[0]
    roots = sized(e.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct(), rows)
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
