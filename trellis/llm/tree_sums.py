"""Subtree sums of a forest by parallel tree contraction.

Every round first rakes: all leaves go, and their sums are added to their parents. Then it
compresses: among the unary nodes (one child left, not a root) those go whose rank is below that
of their unary parent and of their unary child; the child takes the place of its parent and notes
what its parent would have added on the way up. Ranks follow the number of trailing zeros of the
depth, so that a fresh chain loses every second node and a chain of n nodes about log2(n) rounds.
Raked nodes have their sums at once. Then the rounds are walked back: a node that was compressed
away gets the sum of the child it had, which went in a later round, plus the noted amount.

A round is a few joins on node names and one partial aggregation by parent; no node is joined to
more than one other one, so a node with any number of children is no hot key. Live nodes shrink by
a constant share in every round; each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import shared_table, sized


def _rank(depth: Column, node: Column) -> Column:
    """Trailing zeros of the depth, ties by a hash and the name."""
    low = depth.bitwiseAND(-depth)
    return F.struct(low.alias("zeros"), F.xxhash64(node).alias("hash"), node.alias("node"))


def subtree_sums(nodes: DataFrame, sums: Sequence[str]) -> DataFrame:
    """``node`` and, for every column of ``sums``, its total over the node's subtree (itself
    included), from ``nodes (node, parent, depth, *sums)``: a written table, names are unique and
    not null, parents of roots are null, depth grows from parent to child."""
    kids = nodes.groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("kids"))
    live = nodes.join(kids, F.col("node") == F.col("p"), "left").select(
        "node", "parent", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), *[F.col(c).cast("long").alias(c) for c in sums],
        *[F.lit(0).cast("long").alias(f"up_{c}") for c in sums])
    live = shared_table(live, "tree-live")
    gone: list[tuple[DataFrame, DataFrame]] = []
    rows = live.count()
    while rows:
        raked = live.where("kids = 0")
        to_parent = sized(raked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(
            F.count(F.lit(1)).alias("raked"), *[F.sum(F.col(c) + F.col(f"up_{c}")).alias(f"add_{c}") for c in sums]), rows)
        rest = sized(live.where("kids > 0").join(to_parent, F.col("node") == F.col("p"), "left"), rows).select(
            "node", "parent", "depth", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"),
            *[(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in sums], *[f"up_{c}" for c in sums])
        rest = shared_table(rest, "tree-raked")
        unary = rest.where("kids = 1 AND parent IS NOT NULL").select(
            "node", "parent", _rank(F.col("depth"), F.col("node")).alias("rank"))
        above = unary.select(F.col("node").alias("p"), F.col("rank").alias("p_rank"))
        losers = unary.join(above, F.col("parent") == F.col("p")).select(
            F.when(F.col("rank") < F.col("p_rank"), F.col("p")).otherwise(F.col("node")).alias("node"))
        cut = sized(unary.select("node").join(losers, "node", "left_anti"), rows)
        marked = sized(rest.join(cut.select("node", F.lit(True).alias("cut")), "node", "left"), rows)
        spliced = marked.where("cut").select(
            F.col("node").alias("v"), F.col("parent").alias("v_parent"),
            *[F.col(c).alias(f"v_{c}") for c in sums], *[F.col(f"up_{c}").alias(f"v_up_{c}") for c in sums])
        after = shared_table(sized(marked.join(spliced, F.col("parent") == F.col("v"), "left"), rows), "tree-cut")
        moved = F.col("v").isNotNull()
        # a spliced node's sum is its child's, what the child carries up and its own
        noted = after.where(moved).select(
            F.col("v").alias("node"), F.col("node").alias("child"),
            *[(F.col(f"up_{c}") + F.col(f"v_{c}")).alias(f"add_{c}") for c in sums])
        gone.append((raked.select("node", *sums), noted))
        live = after.where("cut IS NULL").select(
            "node", F.when(moved, F.col("v_parent")).otherwise(F.col("parent")).alias("parent"), "depth", "kids", *sums,
            *[(F.col(f"up_{c}") + F.when(moved, F.col(f"v_{c}") + F.col(f"v_up_{c}")).otherwise(0)).alias(f"up_{c}") for c in sums])
        rows = live.count()
    return _expand(gone, list(sums), nodes)


def _expand(gone: list[tuple[DataFrame, DataFrame]], sums: list[str], nodes: DataFrame) -> DataFrame:
    """Walk the rounds back; a node's child went in a later round, so its sum is there."""
    known = nodes.where("false").select("node", *[F.lit(0).cast("long").alias(c) for c in sums])
    for raked, noted in reversed(gone):
        child = known.unionByName(raked).select(F.col("node").alias("k"), *[F.col(c).alias(f"k_{c}") for c in sums])
        found = noted.join(child, F.col("child") == F.col("k")).select(
            "node", *[(F.col(f"k_{c}") + F.col(f"add_{c}")).alias(c) for c in sums])
        known = shared_table(known.unionByName(raked).unionByName(found), "tree-sums")
    return known
