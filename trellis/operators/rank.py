"""Exact running sums and ranks without a single-task window.

``Window.orderBy(x)`` with no partition moves every row into one task, and
``partitionBy(label)`` with two classes gives two tasks. The helpers here use
a two-level scheme instead:

1. every row carries a *bucket* that is non-decreasing in the sort order
   (leading hex digits of a hash, or an approximate-quantile bucket of a
   score), so buckets split the order into many contiguous ranges;
2. ``groupBy(partition, bucket)`` gives per-bucket totals (map-side partial
   aggregation, so the shuffle is tiny) and a window over that small table
   gives the offset of every bucket;
3. a window partitioned by ``(partition, bucket)`` gives the running sum
   inside each bucket; adding the offset makes it global.

The result is exact and spreads the sort over ``#buckets`` tasks. The offsets
table has at most ``#partitions x #buckets`` rows; it is joined without a
hint so AQE can broadcast it after measuring its real size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from trellis.functions.columns import hash_order, hex_bucket

ORDER_HASH = "_h"
BUCKET = "_bucket"


def join_null_safe(df: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on ``cols`` where NULL equals NULL; the columns of ``other``
    other than ``cols`` are added."""
    renamed = other.select(*[F.col(c).alias(f"_r_{c}") for c in cols],
                           *[c for c in other.columns if c not in cols])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(renamed, cond).drop(*[f"_r_{c}" for c in cols])


def running_sums(df: DataFrame, order: Sequence[str | Column], sum_cols: Sequence[str],
                 bucket_col: str, partition_cols: Sequence[str] = (),
                 prefix: str = "cum_", exclusive: bool = False,
                 offsets: DataFrame | None = None) -> DataFrame:
    """Add ``prefix + c`` = running sum of ``c`` in ``order`` within ``partition_cols``.

    ``bucket_col`` must be non-decreasing along ``order`` inside a partition
    and ``order`` must be a total order there (ties make the running sum
    depend on the tie order, exactly as with a plain window). ``offsets``
    (``partition_cols, bucket_col, _off_0, ...``) may be given when they are
    already known (see ``bucket_offsets``).
    """
    parts = list(partition_cols)
    if offsets is None:
        totals = df.groupBy(*parts, bucket_col).agg(
            *[F.sum(c).alias(f"_bt_{i}") for i, c in enumerate(sum_cols)])
        earlier = Window.partitionBy(*parts).orderBy(bucket_col).rowsBetween(
            Window.unboundedPreceding, -1)
        offsets = totals.select(
            *parts, bucket_col,
            *[F.coalesce(F.sum(f"_bt_{i}").over(earlier), F.lit(0)).alias(f"_off_{i}")
              for i in range(len(sum_cols))])
    frame_end = -1 if exclusive else 0
    inside = Window.partitionBy(*parts, bucket_col).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, frame_end)
    joined = join_null_safe(df, offsets, [*parts, bucket_col])
    out = joined.select(
        *df.columns,
        *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_off_{i}")).alias(prefix + c)
          for i, c in enumerate(sum_cols)])
    return out


ROWS_PER_BUCKET = 1 << 21


def auto_digits(n_rows: int | None, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex digits of hash prefix so that a bucket holds ~``rows_per_bucket``
    rows: at least 3 (4,096 buckets), growing with the data."""
    if not n_rows:
        return 3
    need = max(1.0, n_rows / rows_per_bucket)
    return int(min(7, max(3, math.ceil(math.log(need, 16)))))


FINE_DIGITS = 5
#: most rows of an offsets table that is broadcast (a row a partition and bucket, 20 MB)
MOST_OFFSETS = 1 << 19


def bucket_offsets(hashed: DataFrame, partition_cols: Sequence[str] = (),
                   sum_cols: Sequence[str] = (), with_sums: bool = False, digits: int | None = None):
    """Offsets for ``hash_rank``/``running_sums`` with a resolution chosen
    from the data, in one pass over the input.

    Row counts (and sums of ``sum_cols``) per partition and *fine* hash
    bucket (16**5 ranges) are aggregated once and persisted (a small table,
    recomputable from its lineage). The exact partition sizes read from it
    fix the *coarse* bucket resolution (``auto_digits``, or ``digits`` if given);
    coarse buckets are prefixes of fine ones, so they stay monotone in the hash
    order, and their offsets come from a window over the small table. Where the
    data needs more digits than the fine buckets have, they are aggregated
    again at that resolution. NULL partition values are a partition of their own.

    ``hashed`` must carry ``ORDER_HASH``. Returns ``(offsets, digits,
    {partition: rows})``; offsets has ``_off_0`` (rows) then one ``_off_i`` per
    sum column.
    """
    from trellis.session import keep
    parts = list(partition_cols)

    def totals_at(n_digits: int) -> DataFrame:
        fine = hex_bucket(F.col(ORDER_HASH), n_digits).alias("_fine")
        return keep(hashed.groupBy(*parts, fine).agg(
            F.count(F.lit(1)).alias("_s0"),
            *[F.sum(c).alias(f"_s{i + 1}") for i, c in enumerate(sum_cols)]))

    totals = totals_at(FINE_DIGITS)
    part_rows = totals.groupBy(*parts).agg(
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sum_cols) + 1)]).collect()
    per_part = {tuple(r[p] for p in parts): int(r["_s0"]) for r in part_rows}
    sums = {tuple(r[p] for p in parts): [r[f"_s{i}"] or 0 for i in range(len(sum_cols) + 1)]
            for r in part_rows}
    digits = digits or auto_digits(max(per_part.values(), default=0))
    fine_digits = max(FINE_DIGITS, digits)
    if fine_digits > FINE_DIGITS:
        totals = totals_at(fine_digits)
    coarse = totals.groupBy(*parts, F.shiftright("_fine", 4 * (fine_digits - digits)).alias(BUCKET)).agg(
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sum_cols) + 1)])
    earlier = Window.partitionBy(*parts).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.select(*parts, BUCKET, *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0))
                                               .alias(f"_off_{i}") for i in range(len(sum_cols) + 1)])
    if with_sums:
        return offsets, digits, per_part, sums
    return offsets, digits, per_part


def hash_rank(df: DataFrame, key: str | Sequence[str], seed: int, partition_cols: Sequence[str] = (),
              digits: int | None = None, rank_col: str = "rank", n_rows: int | None = None,
              offsets: DataFrame | None = None) -> DataFrame:
    """1-based rank of every row in ``md5(key:seed)`` order within ``partition_cols``.

    Buckets are the leading ``digits`` hex digits of the hash: uniform by
    construction. Unless ``digits``/``offsets`` are given, ``bucket_offsets``
    sizes them from the exact row count in the same pass that gives the
    offsets. Keys must be unique (row identity).
    """
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    few_parts = None
    if offsets is None and digits is None:
        offsets, digits, per_part = bucket_offsets(df.withColumn(ORDER_HASH, hash_order(key, seed)),
                                                   partition_cols)
        few_parts = len(per_part)
    digits = digits or auto_digits(n_rows)
    parts = list(partition_cols)
    # a content hash settles ties if a key repeats (rows with equal content
    # are interchangeable); unique keys never reach it
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    ties = [F.xxhash64(*[F.col(c) for c in hashable])] if hashable else []
    if offsets is None:
        totals = with_hash_bucket(df, key, seed, digits).groupBy(*parts, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*parts).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*parts, BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off_0"))
    # rows travel with their bucket only; the hash is computed again where they arrive
    dealt = df.withColumn(BUCKET, hex_bucket(hash_order(key, seed), digits)).repartition(*parts, BUCKET)
    inside = Window.partitionBy(*parts, BUCKET).orderBy(ORDER_HASH, *[F.col(k) for k in keys], *ties)
    ranked = dealt.withColumn(ORDER_HASH, hash_order(key, seed)).withColumn("_in", F.row_number().over(inside).cast("long"))
    known = offsets.select(*parts, BUCKET, "_off_0")
    if few_parts is not None and few_parts * 16 ** digits <= MOST_OFFSETS:
        known = F.broadcast(known)
    return join_null_safe(ranked, known, [*parts, BUCKET]).withColumn(rank_col, F.col("_in") + F.col("_off_0")) \
        .drop("_in", BUCKET, "_off_0")


def with_hash_bucket(df: DataFrame, key, seed: int, digits: int) -> DataFrame:
    """Order hash and its leading-digit bucket."""
    h = df.withColumn(ORDER_HASH, hash_order(key, seed))
    return h.withColumn(BUCKET, hex_bucket(F.col(ORDER_HASH), digits))


def with_next(df: DataFrame, order: Sequence[str | Column], bucket_col: str, cols: Sequence[str],
              partition_cols: Sequence[str] = (), prefix: str = "next_") -> DataFrame:
    """Add the values of ``cols`` on the following row in ``order`` (``lead``)
    without a single-task window: ``lead`` inside each bucket, and for the
    last row of a bucket the first row of the next non-empty bucket, taken
    from a table with one row per bucket."""
    parts = list(partition_cols)
    w = Window.partitionBy(*parts, bucket_col).orderBy(*order)
    x = df.select("*", *[F.lead(c).over(w).alias(f"_nx_{c}") for c in cols],
                  F.row_number().over(w).alias("_rn"))
    firsts = x.where(F.col("_rn") == 1).select(*parts, bucket_col,
                                               *[F.col(c).alias(f"_f_{c}") for c in cols])
    wb = Window.partitionBy(*parts).orderBy(bucket_col)
    nxt = firsts.select(*parts, bucket_col, *[F.lead(f"_f_{c}").over(wb).alias(f"_nb_{c}") for c in cols])
    out = join_null_safe(x, nxt, [*parts, bucket_col])
    return out.select(*df.columns, *[F.coalesce(F.col(f"_nx_{c}"), F.col(f"_nb_{c}")).alias(prefix + c)
                                     for c in cols])
