"""Prefix trie of conversations with subtree totals (operator 12).

A node is a distinct sequence of first turns; conversations that start with it are its members.
The members of a node share a name: the running xor of a 128-bit hash of (position, role, text),
so names need one pass over the turns and the parent's name is the node's without its last turn.
Counting members by name gives the nodes, where any number of members is pre-aggregated on the map
side. From there a node is its smallest member and its depth, and ``tree_sums`` contracts the tree
for the totals of every subtree.

The list of a node's conversations that end there may be long: ids are joined in spans of ``SPAN``
ids first, and the spans run through SHA-256 one after another, so that no task holds a list.

Defined results: rows without conv_id belong to no conversation and are left out; NULL role or text
is empty; rows are ordered by turn (NULL first), then by a hash of role and text, so repeated rows stay,
each a turn of its own; empty texts are turns like others; long texts are only hashed and measured; an
empty table gives no node; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import shared_table
from trellis.llm.tree_sums import subtree_sums
from trellis.llm.turn_order import numbered

#: conversation ids that one joined span covers, and positions of a rebuilt conversation in one group
SPAN, POSITIONS = 4096, 512
#: a parent with more than this share of all nodes is joined apart; there are fewer than the inverse
HOT_SHARE = 200


def shared_turns(conv: Column, most: int = 6) -> Column:
    """How many first turns a conversation takes over from the first of its hundred."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(most)).cast("int")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, turn, points`` of every turn of the rebuilt conversations (``turn`` a hash of
    role and text, ``points`` the text's length) and ``conv_id`` of all of them."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    short = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), F.length(text).alias("points"),
        F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("turn"))
    own = shared_table(numbered(short, "conv_id", "at", ["turn"]).select(
        "conv_id", F.col("_pos").alias("pos"), "turn", "points"), "trie-turns")
    convs = own.groupBy("conv_id").agg(F.lit(1).alias("_")).select("conv_id")
    taken = shared_turns(F.col("conv_id"))
    first = own.where("conv_id % 100 = 0 AND pos < 6").select(F.col("conv_id").alias("base"), "pos", "turn", "points")
    lengths = first.groupBy("base").agg(F.max("pos").alias("n"))
    based = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    head = based.join(first, "base").where(F.col("pos") <= taken).select("conv_id", "pos", "turn", "points")
    tail = own.where(F.col("pos") > taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100) \
        .join(lengths, "base", "left").select(
            "conv_id", (F.col("pos") - taken + F.least(taken, F.coalesce("n", F.lit(0)))).alias("pos"), "turn", "points")
    return head.unionByName(tail), convs


def _lanes(turn: Column, pos: Column) -> tuple[Column, Column]:
    return F.xxhash64(turn, pos), F.xxhash64(pos, turn, F.lit("lane"))


def _named(rebuilt: DataFrame) -> DataFrame:
    """Every (conversation, depth) with the name of its node (``x, y``) and of the parent (``px, py``)."""
    a, b = _lanes(F.col("turn"), F.col("pos"))
    rows = rebuilt.select("conv_id", "pos", "points", a.alias("a"), b.alias("b"), F.floor((F.col("pos") - 1) / POSITIONS).alias("span"))
    inside = Window.partitionBy("conv_id", "span").orderBy("pos")
    spans = rows.groupBy("conv_id", "span").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"), F.max("pos").alias("top"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"),
                         F.coalesce(F.bit_xor("sa").over(before), zero).alias("oa"),
                         F.coalesce(F.bit_xor("sb").over(before), zero).alias("ob"),
                         F.max("top").over(Window.partitionBy("conv_id")).alias("turns"))
    run = rows.select("*", F.bit_xor("a").over(inside).alias("xa"), F.bit_xor("b").over(inside).alias("xb"))
    run = run.join(spans, (F.col("conv_id") == F.col("c")) & (F.col("span") == F.col("s")))
    x, y = F.col("xa").bitwiseXOR(F.col("oa")), F.col("xb").bitwiseXOR(F.col("ob"))
    return run.select("conv_id", F.col("pos").cast("long").alias("depth"), F.col("points").cast("long").alias("points"),
                      x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("a")).alias("px"), y.bitwiseXOR(F.col("b")).alias("py"),
                      (F.col("pos") == F.col("turns")).alias("ends"))


def _streamed_sha(batches):
    """SHA-256 of a node's spans in order; the rows of a node follow one another."""
    name, digest = None, None
    for pdf in batches:
        out = []
        for x, y, depth, ids in zip(pdf.x, pdf.y, pdf.depth, pdf.ids):
            if (x, y, depth) != name:
                if name is not None:
                    out.append((*name, digest.hexdigest()))
                name, digest = (x, y, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["x", "y", "depth", "ends_sha256"])
    if name is not None:
        yield pd.DataFrame([(*name, digest.hexdigest())], columns=["x", "y", "depth", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """``x, y, depth, ends_sha256`` of the nodes where conversations end."""
    spans = members.where("ends").groupBy("x", "y", "depth", F.floor(F.col("conv_id") / SPAN).alias("span")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids"))
    spans = spans.repartition("x", "y", "depth").sortWithinPartitions("x", "y", "depth", "span")
    return spans.select("x", "y", "depth", "ids").mapInPandas(_streamed_sha, "x long, y long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (subtree totals) and ``ends_sha256``."""
    rebuilt, convs = rebuilt_turns(conversations)
    named = shared_table(_named(rebuilt), "trie-members")
    zero = F.lit(0).cast("long")
    turnless = convs.join(named.where("depth = 1"), "conv_id", "left_anti")
    root = convs.join(turnless.withColumn("ends", F.lit(True)), "conv_id", "left").select(
        "conv_id", zero.alias("depth"), zero.alias("points"), zero.alias("x"), zero.alias("y"),
        F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), F.coalesce("ends", F.lit(False)).alias("ends"))
    members = named.unionByName(root)
    by_name = shared_table(members.groupBy("x", "y", "depth", "px", "py").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("points").alias("points")), "trie-nodes")
    nodes = shared_table(_with_parents(by_name), "trie-tree")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    me = F.struct("conv_id", "depth")
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    totals = subtree_sums(nodes.select(me.alias("node"), parent.alias("parent"), "depth", leaf.alias("n_leaves"),
                                       ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens")),
                          ["n_leaves", "saved_tokens"])
    out = nodes.join(totals.select("node.conv_id", "node.depth", "n_leaves", "saved_tokens"), ["conv_id", "depth"])
    ends = _ends(members).withColumnRenamed("depth", "d").withColumnRenamed("x", "ex").withColumnRenamed("y", "ey")
    out = out.join(ends, (F.col("x") == F.col("ex")) & (F.col("y") == F.col("ey")) & (F.col("depth") == F.col("d")), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _with_parents(by_name: DataFrame) -> DataFrame:
    """Nodes with the smallest member of their parent and their number of children. Parents of more
    than 1 in ``HOT_SHARE`` nodes are fewer than ``HOT_SHARE``: they are broadcast, so their children
    stay where they are; the others meet their children in a join by name."""
    kids = by_name.where("depth > 0").groupBy("px", "py", (F.col("depth") - 1).alias("d")).agg(
        F.count(F.lit(1)).alias("n_children"))
    same = lambda a, b: F.expr(f"x = {a} AND y = {b}") & (F.col("depth") == F.col("d"))
    counted = shared_table(by_name.join(kids.withColumnRenamed("px", "kx").withColumnRenamed("py", "ky"), same("kx", "ky"), "left")
                           .select(*by_name.columns, F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children")), "trie-kids")
    least = counted.count() / HOT_SHARE
    parents = counted.where("n_children > 0").select(
        F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("depth") + 1).alias("ad"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    meets = (F.col("px") == F.col("ax")) & (F.col("py") == F.col("ay")) & (F.col("depth") == F.col("ad"))
    cols = [*counted.columns, "parent_conv_id"]
    hot = counted.join(F.broadcast(parents.where(F.col("siblings") > least)), meets, "left")
    cold = hot.where("parent_conv_id IS NULL AND depth > 0").select(*counted.columns).join(
        parents.where(F.col("siblings") <= least), meets).select(*cols)
    return hot.where("parent_conv_id IS NOT NULL OR depth = 0").select(*cols).unionByName(cold)
