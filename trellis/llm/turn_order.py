"""Positions of turns inside conversations, also where one conversation holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: turn numbers that one group of a conversation spans
SPAN = 512


def numbered(rows: DataFrame, conv: str, turn: str, ties: list[str]) -> DataFrame:
    """``rows`` with ``_pos`` (from 1) of every row in its conversation, by ``turn`` (NULL first),
    then ``ties``, and ``_rows``, the conversation's number of rows.

    A conversation is cut into spans of ``SPAN`` turn numbers; rows are ranked inside their span and
    spans get offsets from their counts, so a long conversation is not one task's work. Rows that
    agree in turn and ties are alike, so their order does not matter.
    """
    cols = rows.columns
    span = F.floor(F.col(turn) / SPAN)
    inside = Window.partitionBy(conv, "_span").orderBy(F.col(turn).asc_nulls_first(), *ties)
    ranked = rows.select(*cols, span.alias("_span")).withColumn("_in", F.row_number().over(inside))
    counts = rows.groupBy(F.col(conv).alias("_c"), span.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_c").orderBy(F.col("_s").asc_nulls_first())
    offsets = counts.select("_c", "_s", (F.sum("_n").over(before) - F.col("_n")).alias("_base"),
                            F.sum("_n").over(Window.partitionBy("_c")).alias("_rows"))
    same: Column = F.col(conv).eqNullSafe(F.col("_c")) & F.col("_span").eqNullSafe(F.col("_s"))
    return ranked.join(offsets, same).select(*cols, (F.col("_base") + F.col("_in")).alias("_pos"), "_rows")
