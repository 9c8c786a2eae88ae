"""Exact, reproducible splits and folds.

Row order is ``md5(key:seed)``: it depends only on the key, so the result is
identical for any partitioning or file order, and any engine with ``md5``
reproduces it. A split ends at a hash that is found by counting hash ranges, so its rows
stay where they are; the ranks of folds come from the two levels of ``rank.py``
(no single-task window). Keys must identify rows uniquely. No row is lost: a NULL
class is a class of its own (last in ties), and a NULL key is hashed like any
other (rows that share a key are ordered by a hash of their content).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from fractions import Fraction

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from trellis.operators.rank import ORDER_HASH, hash_rank
from trellis.functions.columns import hash_order

# Fixed values of the reference workflow.
TEST_FRACTION = 0.2
SEED = 42
LEARNING_FRACTIONS = tuple(float(x) for x in np.linspace(0.1, 1.0, 5))


def _ceil_fraction(n: int, frac: float) -> int:
    f = Fraction(str(frac))
    return -((-n * f.numerator) // f.denominator)


def stratum_quotas(counts: dict, test_fraction: float = TEST_FRACTION) -> dict:
    """Test rows per class: ``n_test = ceil(f * n)`` shared by largest
    remainder of ``n_c * n_test / n`` (ties: smaller class value first).
    Reproduces the reference's split tables exactly."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    n_test = _ceil_fraction(n, test_fraction)
    base = {c: (k * n_test) // n for c, k in counts.items()}
    rem = {c: (k * n_test) % n for c, k in counts.items()}
    left = n_test - sum(base.values())
    known = [c for c in counts if c is not None]
    order = sorted(known, key=lambda c: (-rem[c], c))
    if len(known) < len(counts):  # the NULL class comes after its equals
        order.insert(sum(rem[c] >= rem[None] for c in known), None)
    for c in order[:left]:
        base[c] += 1
    return base


def _lookup(col: str, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        cond = F.col(col).eqNullSafe(F.lit(k))
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr if expr is not None else F.lit(None)


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = TEST_FRACTION,
                     seed: int = SEED, split_col: str = "split", digits: int | None = None) -> DataFrame:
    """Exact stratified train/test split as a ``split`` column.

    Class counts (one row per class) reach the driver to fix the quotas; each
    row's place in its class's hash order decides ``test`` vs ``train``.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    return _first_rows(df, key, stratum_quotas(counts, test_fraction), label, seed, split_col, digits)


def random_split(df: DataFrame, key: str, test_fraction: float = TEST_FRACTION, seed: int = SEED,
                 split_col: str = "split", digits: int | None = None) -> DataFrame:
    """Exact-size random split: the ``ceil(f * n)`` first rows in hash order are
    the test part (R2)."""
    return _first_rows(df, key, {0: _ceil_fraction(df.count(), test_fraction)}, None, seed, split_col, digits)


def _first_rows(df: DataFrame, key: str, quotas: dict, label: str | None, seed: int, split_col: str, digits: int | None) -> DataFrame:
    """``test`` for the first rows of every class in hash order, as many as its quota, else ``train``. The last hash of a quota is
    found by counting hash ranges, like those of ``learning_cuts``; after that the split is a narrow expression:
    no row is ranked or shuffled. Only where a quota ends among rows of one hash (a repeated key) are those ranked."""
    classes = list(quotas)
    number = F.lit(0) if label is None else _lookup(label, {c: i for i, c in enumerate(classes)})
    value = lambda of: F.get(F.array(*[F.lit(of.get(i)).cast("string") for i in range(len(classes))]), number)
    hashed = df.select(hash_order(key, seed).alias(ORDER_HASH), number.alias("_c"))
    cuts = _hash_cuts(hashed, {i: quotas[c] for i, c in enumerate(classes)}, digits or CUT_DIGITS)
    if not cuts:
        return df.withColumn(split_col, F.lit("train"))
    h = hash_order(key, seed)
    whole = F.coalesce(h <= value({i: c[0] for i, c in cuts.items()}), F.lit(False))
    named = lambda test: F.when(test, "test").otherwise("train")
    parted = {i: c for i, c in cuts.items() if c[1] < c[2]}
    if not parted:
        return df.withColumn(split_col, named(whole))
    tied = F.coalesce(h == value({i: c[0] for i, c in parted.items()}), F.lit(False))
    ties = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    keys = key if isinstance(key, (list, tuple)) else [key]
    order = Window.partitionBy("_c").orderBy(*keys, F.xxhash64(*ties))
    few = df.where(tied).withColumn("_c", number).withColumn("_rank", F.row_number().over(order))
    few = few.withColumn(split_col, named(F.col("_rank") <= value({i: c[1] for i, c in parted.items()}).cast("long")))
    return df.where(~tied).withColumn(split_col, named(whole)).unionByName(few.drop("_c", "_rank"))


def _hash_cuts(hashed: DataFrame, quotas: dict[int, int], step: int) -> dict[int, tuple[str, int, int]]:
    """``{class: (hash of its last wanted row, wanted rows of that hash, rows of that hash)}``. The driver holds counts of
    a few thousand ranges a class at a time."""
    open_ = {c: ("", q) for c, q in quotas.items() if q > 0}     # range prefix that holds the last row, rows still to go in it
    digits, most = 0, CUT_ROWS + 1
    while open_ and most > CUT_ROWS and digits < 32:
        prefixes = sorted({p for p, _ in open_.values()})
        inside = hashed if not digits else hashed.where(F.substring(ORDER_HASH, 1, digits).isin(prefixes))
        digits, most = min(32, digits + step), 0
        table: dict = {}
        for r in inside.groupBy(F.substring(ORDER_HASH, 1, digits).alias("p"), "_c").count().collect():
            table.setdefault(r["_c"], []).append((r["p"], r["count"]))
        for c, (prefix, left) in open_.items():
            for p, n in sorted(x for x in table[c] if x[0].startswith(prefix)):
                if left <= n:
                    break
                left -= n
            open_[c] = (p, left)
            most = max(most, n)
    if not open_:
        return {}
    found: dict = {}
    last = hashed.where(F.substring(ORDER_HASH, 1, digits).isin(sorted({p for p, _ in open_.values()})))
    for r in last.groupBy(ORDER_HASH, "_c").count().collect():
        found.setdefault(r["_c"], []).append((r[ORDER_HASH], r["count"]))
    cuts = {}
    for c, (prefix, left) in open_.items():
        for h, n in sorted(x for x in found[c] if x[0].startswith(prefix)):
            if left <= n:
                cuts[c] = (h, left, n)
                break
            left -= n
    return cuts


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED,
                     fold_col: str = "fold", digits: int | None = None,
                     n_rows: int | None = None) -> DataFrame:
    """Per-class balanced folds: ``fold = (rank in class - 1) mod k``.
    ``n_rows`` (largest class) sizes the hash buckets; 4,096 when unknown."""
    ranked = hash_rank(df, key, seed, [label], digits=digits, rank_col="_rank", n_rows=n_rows)
    return ranked.withColumn(fold_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", ORDER_HASH)


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = SEED, fold_col: str = "fold",
          digits: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Balanced folds without classes: ``fold = (rank - 1) mod k``."""
    ranked = hash_rank(df, key, seed, digits=digits, rank_col="_rank", n_rows=n_rows)
    return ranked.withColumn(fold_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", ORDER_HASH)


#: hash digits that one refinement step of ``learning_cuts`` adds, and rows of a bucket that are looked at one by one
CUT_DIGITS, CUT_ROWS = 3, 1_000


def learning_cuts(folded: DataFrame, key: str, k: int, fold_col: str = "fold", seed: int = SEED,
                  fractions: Sequence[float] = LEARNING_FRACTIONS) -> dict[tuple[int, int], tuple[int, str]]:
    """``{(fold, size number): (size, last hash)}`` of the training subsets (R7): the subset of a fold
    and size is the first ``size`` rows outside the fold in hash order, that is the rows outside the
    fold whose hash is at most the last hash (see ``learning_subset``).

    Rows are counted by hash range and fold; only the ranges where a size falls are counted again at
    a finer resolution, until they are small enough to look at their rows. No row is ranked, nothing but
    counts is shuffled, and the driver holds counts of a few thousand ranges at a time.
    """
    hashed = folded.select(hash_order(key, seed).alias(ORDER_HASH), F.col(fold_col).alias("_f"))
    counts = {r["_f"]: r["count"] for r in hashed.groupBy("_f").count().collect()}
    n = sum(counts.values())
    sizes = {(f, j): s for f in range(k) for j, s in enumerate(learning_sizes(n - counts.get(f, 0), fractions)) if n > counts.get(f, 0)}
    open_ = {c: ("", s) for c, s in sizes.items()}        # range prefix that holds the last row, rows still to go in it
    digits = 0
    while True:
        prefixes = sorted({p for p, _ in open_.values()})
        inside = hashed if not digits else hashed.where(F.substring(ORDER_HASH, 1, digits).isin(prefixes))
        if not prefixes or digits >= 32:
            break
        digits = min(32, digits + CUT_DIGITS)
        table: dict = {}
        for r in inside.groupBy(F.substring(ORDER_HASH, 1, digits).alias("p"), "_f").count().collect():
            table.setdefault(r["p"], {})[r["_f"]] = r["count"]
        ranges = sorted(table)
        most = 0
        for c, (prefix, left) in open_.items():
            for p in ranges[bisect_left(ranges, prefix):]:
                here = sum(table[p].values()) - table[p].get(c[0], 0)
                if left <= here:
                    break
                left -= here
            open_[c] = (p, left)
            most = max(most, sum(table[p].values()))
        if most <= CUT_ROWS:
            break
    rows: dict = {}
    if open_:   # equal hashes (a repeated key) are one row with a count
        wanted = sorted({p for p, _ in open_.values()})
        last = hashed.where(F.substring(ORDER_HASH, 1, digits).isin(wanted)).groupBy(ORDER_HASH, "_f").count()
        for r in last.orderBy(ORDER_HASH).collect():
            rows.setdefault(r[ORDER_HASH][:digits], []).append((r[ORDER_HASH], r["_f"], r["count"]))
    cuts = {}
    for c, (prefix, left) in open_.items():
        for h, f, rows_here in rows[prefix]:
            left -= rows_here if f != c[0] else 0
            if left <= 0:
                cuts[c] = (sizes[c], h)
                break
    return cuts


def learning_subset(folded: DataFrame, key: str, fold: int, last: str, fold_col: str = "fold", seed: int = SEED) -> DataFrame:
    """The training rows of ``fold`` up to the last hash of a subset: a narrow filter."""
    return folded.where(~F.col(fold_col).eqNullSafe(F.lit(fold)) & (hash_order(key, seed) <= F.lit(last)))


def learning_sizes(n_train: int, fractions: Sequence[float] = LEARNING_FRACTIONS) -> list[int]:
    """Absolute subset sizes ``floor(frac * n_train)`` (float product, as the
    reference's ``astype(int)``), at least one row."""
    return [min(max(int(fr * n_train), 1), max(n_train, 1)) for fr in fractions]


def learning_subset_counts(folded: DataFrame, key: str, label: str, k: int, fold_col: str = "fold", seed: int = SEED,
                           fractions: Sequence[float] = LEARNING_FRACTIONS) -> DataFrame:
    """Size, rows and positives of every (fold, size) training subset: one pass of conditional counts."""
    cuts = learning_cuts(folded, key, k, fold_col, seed, fractions)
    h, aggs, items = F.col(ORDER_HASH), [], []
    for (f, j), (size, last) in cuts.items():
        inside = ~F.col(fold_col).eqNullSafe(F.lit(f)) & (h <= F.lit(last))
        aggs += [F.count(F.when(inside, 1)).alias(f"n{f}_{j}"),
                 F.coalesce(F.sum(F.when(inside, F.col(label))), F.lit(0)).cast("long").alias(f"p{f}_{j}")]
        items.append(F.struct(F.lit(f).alias("fold"), F.lit(j).alias("size_idx"), F.lit(size).cast("long").alias("train_size"),
                              F.col(f"n{f}_{j}").alias("n_rows"), F.col(f"p{f}_{j}").alias("n_pos")))
    if not items:
        return folded.sparkSession.createDataFrame([], "fold int, size_idx int, train_size long, n_rows long, n_pos long")
    # only the one-row result is unpivoted
    return folded.withColumn(ORDER_HASH, hash_order(key, seed)).agg(*aggs).select(F.explode(F.array(*items)).alias("s")).select("s.*")


def assert_unique_key(df: DataFrame, key) -> None:
    """Raise if ``key`` (a column or a list of columns) repeats: splits and
    folds rank rows by a hash of the key, so a repeated key would tie. One
    grouped pass; it stops at the first repeated key found."""
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"key {keys} is not unique, e.g. {dup[0].asDict()}; "
                         "dedup and use prep.row_key for a content key")
