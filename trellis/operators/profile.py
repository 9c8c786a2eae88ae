"""Column and class profiles.

All statistics are single aggregates over the table (partial aggregation on
the map side, one tiny shuffle); only the small results -- one row per
feature, class or threshold -- are reshaped afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, StringType,
                               StructField, StructType)

from trellis.functions.columns import any_true, numeric_columns, pairwise_corr, safe_div
from trellis.operators.quantiles import exact_quantiles

# Fixed values of the reference workflow.
IQR_FACTOR = 1.5
DEFAULT_THRESHOLDS = (6, 7, 8)
SPLIT_TOLERANCE_PP = 0.5

#: classes whose weights are looked up in a literal
MOST_CLASSES = 100


def binary_columns(df: DataFrame, cols: Sequence[str]) -> set[str]:
    """Columns with at most two distinct non-null values (one aggregate)."""
    if not cols:
        return set()
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).collect()[0]
    small = [c for c in cols if row[c] <= 3]
    if not small:
        return set()
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in small]).collect()[0]
    return {c for c in small if exact[c] <= 2}


def iqr_bound_values(df: DataFrame, cols: Sequence[str], k: float = IQR_FACTOR
                     ) -> dict[str, tuple[float, float, float, float]]:
    """Exact Q1/Q3 (linear interpolation) per column -> (q1, q3, lower, upper)."""
    qs = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = qs[(c, 0.25)], qs[(c, 0.75)]
        if q1 is None or q3 is None:
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def iqr_columns(df: DataFrame, cols: Sequence[str] | None, exclude: Sequence[str] = (),
                skip_binary: bool = False) -> list[str]:
    """Columns the IQR rule applies to: all numeric ones, minus ``exclude``. On request
    (``skip_binary``) also without two-valued marker columns: the rule removes every row of the
    rarer value where that is under a quarter of the rows."""
    if cols is not None:
        return list(cols)
    cand = numeric_columns(df, exclude)
    if skip_binary:
        binary = binary_columns(df, cand)
        cand = [c for c in cand if c not in binary]
    return cand


def iqr_bounds(df: DataFrame, cols: Sequence[str] | None = None, k: float = IQR_FACTOR,
               exclude: Sequence[str] = ()) -> DataFrame:
    """Per-feature ``(feature, q1, q3, iqr, lower, upper)`` (A2)."""
    cols = iqr_columns(df, cols, exclude)
    b = iqr_bound_values(df, cols, k)
    rows = [(c, v[0], v[1], v[1] - v[0], v[2], v[3]) for c, v in b.items()]
    schema = StructType([StructField("feature", StringType())] +
                        [StructField(n, DoubleType()) for n in ("q1", "q3", "iqr", "lower", "upper")])
    return df.sparkSession.createDataFrame(rows, schema)


def outlier_flag(bounds: dict[str, tuple[float, float, float, float]]):
    """Column that is True when any value is strictly outside its bounds.
    NULL never counts as an outlier (trap T-1)."""
    return any_true([(F.col(c) < F.lit(v[2])) | (F.col(c) > F.lit(v[3]))
                     for c, v in bounds.items()])


def iqr_filter(df: DataFrame, cols: Sequence[str] | None = None, k: float = IQR_FACTOR,
               fit_on: DataFrame | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Drop rows with any value below ``Q1 - k*IQR`` or above ``Q3 + k*IQR`` (A3).

    Bounds are learned on ``fit_on`` (default: ``df`` itself -- pass the
    training part only) and enter the plan as literals, so the filter is a
    narrow, codegen'd predicate with no join.
    """
    src = fit_on if fit_on is not None else df
    cols = iqr_columns(src, cols, exclude)
    bounds = iqr_bound_values(src, cols, k)
    return df.where(~outlier_flag(bounds))


def iqr_summary(df: DataFrame, cols: Sequence[str] | None = None, k: float = IQR_FACTOR,
                exclude: Sequence[str] = ()) -> DataFrame:
    """Rows before/after the IQR filter, removed count and share (A1 for A3)."""
    cols = iqr_columns(df, cols, exclude)
    bounds = iqr_bound_values(df, cols, k)
    flag = outlier_flag(bounds)
    return df.agg(F.count(F.lit(1)).alias("initial_rows"),
                  F.count(F.when(~flag, 1)).alias("final_rows")).select(
        "initial_rows", "final_rows",
        (F.col("initial_rows") - F.col("final_rows")).alias("removed"),
        F.try_divide((F.col("initial_rows") - F.col("final_rows")).cast("double") * F.lit(100.0),
                     F.col("initial_rows").cast("double")).alias("removed_pct"))


def threshold_sensitivity(df: DataFrame, score_col: str = "quality",
                          thresholds: Sequence[int] = DEFAULT_THRESHOLDS) -> DataFrame:
    """Class sizes if the label were ``score >= t``, for every t (A4).

    One pass: a conditional count per threshold, then the one-row result is
    unpivoted. NULL scores count as negatives (pandas: NaN >= t is False).
    """
    s = F.col(score_col)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(F.when(s >= F.lit(t), 1)).alias(f"p{i}") for i, t in enumerate(thresholds)]
    one = df.agg(*aggs)
    long = one.select(F.col("n"), F.explode(F.array(*[
        F.struct(F.lit(int(t)).alias("threshold"), F.col(f"p{i}").alias("n_pos"))
        for i, t in enumerate(thresholds)])).alias("t")).select("n", "t.*")
    return long.select(
        "threshold", "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"),
        safe_div(F.col("n_pos") * F.lit(100.0), F.col("n"), zero=None).alias("pos_pct"),
        safe_div(F.col("n") - F.col("n_pos"), F.greatest(F.col("n_pos"), F.lit(1)),
                 zero=None).alias("neg_per_pos"))


def class_distribution(df: DataFrame, label: str, class_col: str = "class") -> DataFrame:
    """``(class, n, frac)`` ordered by class."""
    counts = df.groupBy(F.col(label).alias(class_col)).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()  # over the per-class table: a handful of rows
    return (counts.withColumn("frac", safe_div(F.col("n"), F.sum("n").over(total), zero=None))
            .orderBy(class_col))


def class_weights(df: DataFrame, label: str, class_col: str = "class") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class."""
    counts = df.groupBy(F.col(label).alias(class_col)).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over the per-class table (one row per class)
    return counts.select(
        class_col, "n",
        safe_div(F.sum("n").over(w), F.count(F.lit(1)).over(w) * F.col("n"), zero=None)
        .alias("weight"))


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach balanced weights to every row for ``weightCol`` (J3). Up to ``MOST_CLASSES`` classes are
    looked up in a literal (no join, a frequent class is no hot key); more are joined, as a
    label of that many values is like any other key. A NULL class has no weight."""
    w = class_weights(df, label, "_cls").where(F.col("_cls").isNotNull())
    few = w.limit(MOST_CLASSES + 1).collect()
    if len(few) > MOST_CLASSES:
        return df.join(w.select(F.col("_cls").alias(label), F.col("weight").alias(weight_col)), on=label, how="left")
    found = F.when(F.lit(False), F.lit(None).cast("double"))
    for r in few:
        found = found.when(F.col(label) == F.lit(r["_cls"]), F.lit(r["weight"]))
    return df.withColumn(weight_col, found)


def pos_weight(df: DataFrame, label: str) -> DataFrame:
    """``n_neg / n_pos`` (A10, boosted-tree ``scale_pos_weight``)."""
    y = F.col(label)
    return df.agg(F.count(F.when(y == 1, 1)).alias("n_pos"),
                  F.count(F.when(y == 0, 1)).alias("n_neg")).select(
        "n_pos", "n_neg", safe_div(F.col("n_neg"), F.col("n_pos"), zero=None).alias("pos_weight"))


def split_verification(df: DataFrame, label: str, split_col: str = "split",
                       tolerance_pp: float = SPLIT_TOLERANCE_PP) -> DataFrame:
    """Per class: train/test counts and shares, their gap in percentage
    points, and whether the gap is within ``tolerance_pp`` (A5) -- checked,
    not assumed."""
    s = F.col(split_col)
    per = df.groupBy(F.col(label).alias("class")).agg(
        F.count(F.when(s == "train", 1)).alias("train_n"),
        F.count(F.when(s == "test", 1)).alias("test_n"))
    w = Window.partitionBy()  # over the per-class table (one row per class)
    out = per.select(
        "class", "train_n", "test_n",
        safe_div(F.col("train_n") * F.lit(100.0), F.sum("train_n").over(w), zero=0.0).alias("train_pct"),
        safe_div(F.col("test_n") * F.lit(100.0), F.sum("test_n").over(w), zero=0.0).alias("test_pct"))
    out = out.withColumn("diff_pp", F.abs(F.col("train_pct") - F.col("test_pct")))
    return out.withColumn("within_tol", F.col("diff_pp") <= F.lit(tolerance_pp)).orderBy("class")


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Full Pearson matrix in long form ``(x, y, r)`` (A7): one aggregate for
    all pairs, pairwise-complete, NULL for constant columns."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[pairwise_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    items = []
    for i, (a, b) in enumerate(pairs):
        items.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")))
        if a != b:
            items.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"r{i}").alias("r")))
    return one.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def label_correlation(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Features ranked by Pearson r with the label."""
    cols = list(cols) if cols is not None else numeric_columns(df, [label])
    one = df.agg(*[pairwise_corr(c, label).alias(f"r{i}") for i, c in enumerate(cols)])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(cols)]))
        .alias("p")).select("p.*")
    w = Window.orderBy(F.col("r").desc_nulls_last(), F.col("feature"))  # k rows
    return long.withColumn("rank", F.row_number().over(w))


def polarity_check(df: DataFrame, label: str, group: str, cols: Sequence[str] | None = None
                   ) -> DataFrame:
    """Simpson's-paradox check (A28): r(feature, label) inside every group and pooled, flagging a sign
    that flips. The table is aggregated once by group, to counts, means and co-moments; the pooled
    figures are merged from the groups' (one row a group and feature), so no row is counted twice."""
    cols = list(cols) if cols is not None else numeric_columns(df, [label, group])
    y = F.col(label).cast("double")

    def moments(c: str):
        x = F.col(c).cast("double")
        xa, yb = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return F.struct(F.lit(c).alias("feature"), F.count(F.when(x.isNotNull(), y)).alias("n"),
                        F.avg(xa).alias("mx"), F.avg(yb).alias("my"), F.covar_pop(x, y).alias("cxy"),
                        F.var_pop(xa).alias("cxx"), F.var_pop(yb).alias("cyy"), F.min(xa).alias("x0"), F.max(xa).alias("x1"),
                        F.min(yb).alias("y0"), F.max(yb).alias("y1"))
    long = df.groupBy(F.col(group).cast("string").alias("group")).agg(F.array(*[moments(c) for c in cols]).alias("a")) \
        .select("group", F.explode("a").alias("m")).select("group", "m.*")
    w = Window.partitionBy("feature")  # one row a group
    merged = long.withColumns({"_mx": F.try_divide(F.sum(F.col("n") * F.col("mx")).over(w), F.sum("n").over(w)),
                               "_my": F.try_divide(F.sum(F.col("n") * F.col("my")).over(w), F.sum("n").over(w))})

    def pooled(a: str, b: str):
        return F.sum(F.col("n") * (F.col(f"c{a}{b}") + (F.col(f"m{a}") - F.col(f"_m{a}")) * (F.col(f"m{b}") - F.col(f"_m{b}")))).over(w)

    def r(cxy, cxx, cyy, varies):
        den = F.sqrt(cxx) * F.sqrt(cyy)
        return F.when(varies, F.try_divide(cxy, F.when(den != 0, den)))
    inside = r(F.col("cxy"), F.col("cxx"), F.col("cyy"), (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    varies = (F.min("x0").over(w) < F.max("x1").over(w)) & (F.min("y0").over(w) < F.max("y1").over(w))
    out = merged.select("feature", "group", inside.alias("r_group"), r(pooled("x", "y"), pooled("x", "x"), pooled("y", "y"), varies).alias("r_pooled"))
    return out.select("*", F.coalesce(F.signum("r_group") * F.signum("r_pooled") < 0, F.lit(False)).alias("sign_flip"))


def _vif_of_gram(g: np.ndarray) -> list[float | None]:
    """``G_ii (G^-1)_ii``; for a singular matrix each column's own regression on
    the others (pseudo-inverse): infinite for columns that depend on others,
    finite for the rest, NULL for a column without variation."""
    d = np.sqrt(np.diag(g))
    live = np.flatnonzero(d > 0)
    r = g[np.ix_(live, live)] / np.outer(d[live], d[live])
    vals: list[float | None] = [None] * len(g)
    if len(live) and np.linalg.matrix_rank(r, tol=1e-12, hermitian=True) == len(live):
        inv = np.linalg.inv(g[np.ix_(live, live)])
        for k, i in enumerate(live):
            vals[i] = float(g[i, i] * inv[k, k])
        return vals
    for k, i in enumerate(live):
        rest = np.delete(np.arange(len(live)), k)
        x = r[rest, k]
        left = 1.0 - float(x @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=1e-10, hermitian=True) @ x)
        vals[i] = float("inf") if left < 1e-10 else 1.0 / left
    return vals


def vif(df: DataFrame, cols: Sequence[str] | None = None, centered: bool = False) -> DataFrame:
    """Variance inflation factors ``(feature, vif)``, sorted descending.

    Without intercept (the reference's default), ``VIF_i = G_ii * (G^-1)_ii``
    with ``G = X'X`` -- the regression through the origin. ``centered=True``
    uses the covariance matrix instead (the textbook VIF). One aggregate of
    the k(k+1)/2 cross sums over complete rows; only the k x k matrix reaches
    the driver.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    k = len(cols)
    complete = df.where(F.lit(True) if not cols else
                        F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)))
    xs = [F.col(c).cast("double") for c in cols]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = complete.agg(*aggs).collect()[0]
    n = row["n"]
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    if centered and n:
        s = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
        g = g - np.outer(s, s) / n
    vals = _vif_of_gram(g)
    schema = StructType([StructField("feature", StringType()), StructField("vif", DoubleType())])
    res = df.sparkSession.createDataFrame(list(zip(cols, vals)), schema)
    return res.orderBy(F.col("vif").desc_nulls_last(), F.col("feature"))
