"""Sharding by a hierarchical weighted hash tree (operator 11, native).

A tree of regions, racks and shards holds the weights. A row descends it: at the root, then in
the region, then in the rack, every child makes an exponential draw from a hash of (key, child)
divided by its weight, and the smallest draw wins, so that a child wins with its share of the
weight and a child's draw does not depend on its siblings. If a weight changes, rows move only
between the subtrees that hold it and the rest: into a subtree that became heavier, out of one
that became lighter; rows that stay elsewhere keep their rack and shard.

A tree has room for more shards than are live. A row that lands on a free place draws again
(another attempt number in the hash), so every live shard gets its share of all rows. A shard
that comes into a free place keeps the rows that land there and so takes rows only into itself;
no row moves between older shards. After ``ATTEMPTS`` draws on free places a row takes one draw
among all live shards, to which the same holds.

Everything is column functions. Placing is narrow (no shuffle); ``slots`` numbers the rows of a
shard without a hot group: equal rows are counted first, rows are dealt by ranges of a content
hash, and ranges get their offsets from their counts.

Defined results: a NULL key is the empty text; NULL text has no bytes (size 16) and the checksum
of no bytes; repeated rows get a slot each; long texts are only measured; an empty table gives an
empty result; other columns pass through ``place`` untouched, except that ``shard`` is overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: room of a tree by default: 4 regions of 4 racks of 3 places
REGIONS, RACKS, PLACES = 4, 4, 3
#: draws on free places before the draw among all live shards
ATTEMPTS = 8
#: rows that one range of a shard holds on average, at most
ROWS_A_RANGE = 200_000
#: copies of one row that one task writes out
COPIES_A_TASK = 100_000
#: bytes that a row takes beside its text
ROW_BYTES = 16


class Place(NamedTuple):
    """A place of the tree; ``shard`` is None while it is free."""
    region: str
    rack: str
    name: str
    weight: float
    shard: int | None


def tree(shards: int, regions: int = REGIONS, racks: int = RACKS, places: int = PLACES,
         weights: Sequence[float] | None = None) -> list[Place]:
    """The tree of ``shards`` live shards, dealt in turn to regions, then to racks, so that
    ``tree(n)`` and ``tree(n + 1)`` differ in one place. ``weights`` by place (all 1)."""
    room = regions * racks * places
    if not 0 < shards <= room:
        raise ValueError(f"{shards} shards need a tree of as many places, this one has {room}")
    return [Place(f"r{i % regions}", f"r{i % regions}/k{i // regions % racks}",
                  f"r{i % regions}/k{i // regions % racks}/p{i // (regions * racks)}",
                  float(weights[i]) if weights else 1.0, i if i < shards else None) for i in range(room)]


def _exponential(key: Column, attempt: Column, node: Column) -> Column:
    """-ln(u), u in (0, 1) from the first 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, attempt.cast("string"), node)), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52))


def _draw(key: Column, attempt: Column, children: Column) -> Column:
    """The child with the smallest draw; ties by name."""
    return F.array_min(F.transform(children, lambda c: F.struct(
        (_exponential(key, attempt, c["name"]) / c["weight"]).alias("draw"), c["name"].alias("name"),
        c.alias("child"))))["child"]


def _children(places: list[Place], level: int) -> str:
    """The subtree under one node as an SQL literal: names, weights, children or shards."""
    if level == 2:
        nodes = [f"named_struct('name', '{p.name}', 'weight', {p.weight!r}D, 'shard', CAST({'NULL' if p.shard is None else p.shard} AS INT))"
                 for p in places]
    else:
        groups: dict[str, list[Place]] = {}
        for p in places:
            groups.setdefault(p[level], []).append(p)
        nodes = [f"named_struct('name', '{name}', 'weight', {sum(p.weight for p in ps)!r}D, 'children', {_children(ps, level + 1)})"
                 for name, ps in groups.items()]
    return f"array({', '.join(nodes)})"


def shard_of(key: Column, places: list[Place], attempts: int = ATTEMPTS) -> Column:
    """The shard of a key: region, rack and place by weighted draws, again while the place is free."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    live = [p for p in places if p.shard is not None]
    root = F.expr(_children(places, 0))

    def descend(found: Column, attempt: Column) -> Column:
        region = _draw(key, attempt, root)
        rack = _draw(key, attempt, region["children"])
        return F.when(found.isNotNull(), found).otherwise(_draw(key, attempt, rack["children"])["shard"])

    tries = F.array(*[F.lit(a) for a in range(1 if len(live) == len(places) else attempts)])
    found = F.aggregate(tries, F.lit(None).cast("int"), descend)
    return F.coalesce(found, _draw(key, F.lit(-1), F.expr(_children(live, 2)))["shard"])


def place(docs: DataFrame, key: str, places: list[Place], shard_col: str = "shard") -> DataFrame:
    """``docs`` with the shard of every row; narrow."""
    return docs.withColumn(shard_col, shard_of(F.col(key), places))


def _hex_digits(rows: int, shards: int) -> int:
    digits = 2
    while rows > shards * ROWS_A_RANGE * 16 ** digits:
        digits += 1
    return digits


def slots(placed: DataFrame, shards: int, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``placed`` with gapless numbers from 0 in every shard, in the order of a hash of the row.

    Equal rows are counted before anything is shuffled by content, so a row that is repeated any
    number of times is one row of a range; its copies are written out by several tasks. ``shards``
    only sizes the ranges.
    """
    cols = [c for c in placed.columns if c != slot_col]
    order = F.md5(F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols if c != shard_col]))
    packed = placed.select(F.col(f"`{shard_col}`").alias("g"), order.alias("h"), F.struct(*[f"`{c}`" for c in cols]).alias("row"))
    counted = packed.groupBy("g", "h", "row").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("b", F.substring("h", 1, _hex_digits(placed.count(), shards)))
    # ranges of a shard, few enough for one window a shard
    before = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy("g", "b").agg(F.sum("n").alias("n")).select(
        F.col("g").alias("g2"), F.col("b").alias("b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("g", "b").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = counted.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    at = at.join(offsets, F.col("g").eqNullSafe(F.col("g2")) & (F.col("b") == F.col("b2")))
    step = F.lit(COPIES_A_TASK).cast("long")
    pieces = at.select("row", "n", (F.col("at") + F.col("base")).alias("at"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)).alias("from"))
    copies = pieces.repartition("at", "from").select("row", "at", F.explode(F.sequence(
        F.col("from"), F.least(F.col("from") + step, F.col("n")) - 1)).alias("copy"))
    return copies.select("row.*", (F.col("at") + F.col("copy")).alias(slot_col))


def digest(docs: DataFrame, shards: int, grown: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard after growth for every document, with its size and checksum."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(t).alias("text_crc32"))
    placed = place(place(rows, "doc_id", tree(shards)), "doc_id", tree(grown), "grown_shard")
    return slots(placed, shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, key: str, places: list[Place], path: str, files: int = 1) -> DataFrame:
    """Write whole rows as Parquet, one folder a shard with up to ``files`` files: rows of a shard
    are dealt by a hash of their content, so a repeated key is spread too. Returns what was written."""
    placed = place(docs, key, places)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files))
    live = sum(p.shard is not None for p in places)
    placed.repartition(live * files, "shard", salt).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
