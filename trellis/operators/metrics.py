"""Exact evaluation metrics on a scored DataFrame (A12, A13, A17, A19-A22, A24,
A25, A27, M1).

A scored table has a label column (0/1), a prediction column (0/1) and
optionally a probability/score column. Every metric is one aggregate of
conditional counts or sums (partial aggregation, so the shuffle carries a
handful of numbers per task); only the tiny result tables are reshaped.
``zero_division`` follows the reference: an undefined ratio is 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.columns import safe_div, student_t_two_sided_p

# Fixed values of the reference workflow.
SIGNIFICANCE_LEVEL = 0.05
MIN_RELIABLE_FOLDS = 5
HIST_BINS = 30


def confusion_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction"
                     ) -> DataFrame:
    """One row ``tp, fp, fn, tn`` (bigint)."""
    y, p = F.col(label), F.col(prediction)
    return scored.agg(F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
                      F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
                      F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
                      F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"))


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction"
                     ) -> DataFrame:
    """Dense 2x2 matrix in long form ``(actual, predicted, n)``; zero cells kept."""
    c = confusion_counts(scored, label, prediction)
    cells = [(1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(k).alias("n"))
        for a, b, k in cells])).alias("c")).select("c.*")


def metrics_from_counts(counts: DataFrame, model: str | None = None, auc=None) -> DataFrame:
    """accuracy, precision, recall, F1 (zero_division=0) and ROC-AUC from a
    ``tp, fp, fn, tn`` row."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    cols = []
    if model is not None:
        cols.append(F.lit(model).alias("model"))
    cols += [safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
             precision.alias("precision"), recall.alias("recall"),
             safe_div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"),
             (F.lit(auc) if not hasattr(auc, "alias") else auc).cast("double").alias("roc_auc")]
    return counts.select(*cols)


def binary_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                   probability: str | None = None, model: str | None = None) -> DataFrame:
    """The reference's metric row (A13). Without a probability column ROC-AUC
    is 0.5, as the reference does for models without ``predict_proba``."""
    auc = 0.5
    if probability is not None:
        from trellis.operators.curves import roc_auc_value
        auc = roc_auc_value(scored, label, probability)
        if auc is None:  # one class only: undefined; the reference reports 0.5
            auc = 0.5
    return metrics_from_counts(confusion_counts(scored, label, prediction), model, auc)


def classification_report(scored: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted
    averages (A20). Works for any number of classes: the (actual, predicted)
    count table has at most k^2 rows."""
    cells = scored.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    long = cells.select(F.explode(F.array(
        F.struct(F.col("y").cast("string").alias("class"), F.col("n").alias("sup"),
                 F.lit(0).cast("long").alias("pred"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").cast("string").alias("class"), F.lit(0).cast("long").alias("sup"),
                 F.col("n").alias("pred"), F.lit(0).cast("long").alias("tp")))).alias("c")).select("c.*")
    per = long.groupBy("class").agg(F.sum("sup").alias("support"), F.sum("pred").alias("npred"),
                                    F.sum("tp").alias("tp"))
    per = per.select("class", "support", "tp",
                     safe_div(F.col("tp"), F.col("npred")).alias("precision"),
                     safe_div(F.col("tp"), F.col("support")).alias("recall"))
    per = per.withColumn("f1", safe_div(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall")))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                  F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    avgs = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 safe_div(F.col("tp"), F.col("n")).alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"),
                 safe_div(F.col("sp"), F.col("k")).alias("precision"),
                 safe_div(F.col("sr"), F.col("k")).alias("recall"),
                 safe_div(F.col("sf"), F.col("k")).alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"),
                 safe_div(F.col("wp"), F.col("n")).alias("precision"),
                 safe_div(F.col("wr"), F.col("n")).alias("recall"),
                 safe_div(F.col("wf"), F.col("n")).alias("f1"), F.col("n").alias("support")))).alias("a")).select("a.*")
    return per.select("class", "precision", "recall", "f1", "support").unionByName(avgs)


def regression_metrics(scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
                       ) -> DataFrame:
    """n, MSE, RMSE, MAE and R^2 = 1 - SSE/SST in one aggregate."""
    e = F.col(actual).cast("double") - F.col(predicted).cast("double")
    one = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"),
                     F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
                     (F.var_pop(F.col(actual)) * F.count(F.col(actual))).alias("_sst"))
    return one.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"))


def fold_scores(scored: DataFrame, models: dict[str, str], label: str = "label",
                fold: str = "fold") -> DataFrame:
    """Positive-class F1 of every model on every fold: long ``(model, fold, score)``.
    ``models`` maps a model name to its prediction column. One aggregate."""
    y = F.col(label)
    aggs = []
    for i, (_, pcol) in enumerate(models.items()):
        p = F.col(pcol)
        aggs += [F.count(F.when((y == 1) & (p == 1), 1)).alias(f"tp{i}"),
                 F.count(F.when((y == 0) & (p == 1), 1)).alias(f"fp{i}"),
                 F.count(F.when((y == 1) & (p == 0), 1)).alias(f"fn{i}")]
    per = scored.groupBy(fold).agg(*aggs)
    items = [F.struct(F.lit(name).alias("model"),
                      safe_div(F.lit(2.0) * F.col(f"tp{i}"),
                               F.lit(2.0) * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")).alias("score"))
             for i, name in enumerate(models)]
    return per.select(F.col(fold).alias("fold"), F.explode(F.array(*items)).alias("s")) \
        .select("s.model", "fold", "s.score")


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of the fold scores per model."""
    return scores.groupBy("model").agg(F.count(F.lit(1)).alias("n_folds"),
                                       F.avg("score").alias("mean"),
                                       F.stddev_pop("score").alias("std"))


def paired_t_test(scores: DataFrame, model_a: str, model_b: str,
                  alpha: float = SIGNIFICANCE_LEVEL) -> DataFrame:
    """Paired t-test on the same folds (A22): ``t = mean(d) / (sd(d) / sqrt(n))``
    with ``d = a - b``, two-sided p from Student's t with n-1 degrees of
    freedom in closed form. ``reliable`` is False under 5 folds (the
    reference's warning)."""
    pair = scores.where(F.col("model").isin(model_a, model_b)).groupBy("fold").agg(
        F.max(F.when(F.col("model") == model_a, F.col("score"))).alias("a"),
        F.max(F.when(F.col("model") == model_b, F.col("score"))).alias("b"))
    pair = pair.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    n = pair.count()  # folds: a handful of rows
    stats = pair.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"),
                     F.stddev_samp(F.col("a") - F.col("b")).alias("sd"))
    t = F.try_divide(F.col("mean_diff"), F.try_divide(F.col("sd"), F.sqrt(F.col("n").cast("double"))))
    out = stats.select(F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b"), "n",
                       "mean_diff", t.alias("t_stat"))
    out = out.withColumn("p_value", student_t_two_sided_p(F.col("t_stat"), int(n) - 1))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < F.lit(alpha), F.lit(False))) \
        .withColumn("reliable", F.col("n") >= F.lit(MIN_RELIABLE_FOLDS))


def box_stats(scores: DataFrame, group: str = "model", value: str = "score") -> DataFrame:
    """Box-plot numbers per group (A23): quartiles (linear), whiskers at the
    most extreme points within 1.5 IQR, and the number of fliers. The input is
    a fold-score table (models x folds rows), so the exact ``percentile``
    buffer is bounded by the number of folds."""
    q = scores.groupBy(group).agg(
        F.percentile(F.col(value), [0.25, 0.5, 0.75]).alias("_q"))
    q = q.select(group, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    j = scores.join(F.broadcast(q), on=group)  # one row per group
    lo = F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_low"),
        F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count(F.when((v < lo) | (v > hi), 1)).alias("n_fliers"))


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram between min and max, last bin closed (A24):
    ``(bin, lo, hi, n)`` with empty bins kept. Two aggregates: bounds, then
    one conditional count per bin."""
    b = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    mn, mx = b["mn"], b["mx"]
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (mx - mn) if mx > mn else 1.0
    x = F.col(col).cast("double")
    idx = F.least(F.floor((x - F.lit(mn)) * F.lit(bins) / F.lit(width)), F.lit(bins - 1)).cast("int")
    one = df.where(x.isNotNull()).agg(*[F.count(F.when(idx == i, 1)).alias(f"b{i}")
                                        for i in range(bins)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("bin"),
                 (F.lit(mn) + F.lit(i) * F.lit(width) / F.lit(bins)).alias("lo"),
                 (F.lit(mn) + F.lit(i + 1) * F.lit(width) / F.lit(bins)).alias("hi"),
                 F.col(f"b{i}").alias("n")) for i in range(bins)])).alias("h")).select("h.*")


def joint_counts(df: DataFrame, x: str, y: str, bins: int = HIST_BINS) -> DataFrame:
    """Actual-vs-predicted as 2-D bin counts over a shared range (A25): the
    scale-safe form of a scatter plot with its identity line."""
    b = df.agg(F.least(F.min(x), F.min(y)).alias("mn"), F.greatest(F.max(x), F.max(y)).alias("mx")).first()
    mn, mx = b["mn"], b["mx"]
    width = (mx - mn) if (mn is not None and mx > mn) else 1.0
    mn = mn if mn is not None else 0.0

    def idx(c):
        return F.least(F.floor((F.col(c).cast("double") - F.lit(mn)) * F.lit(bins) / F.lit(width)),
                       F.lit(bins - 1)).cast("int")
    return df.groupBy(idx(x).alias("bin_x"), idx(y).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def compare_models(rows: Sequence[DataFrame]) -> DataFrame:
    """Metric rows of several models as one table in insertion order."""
    out = None
    for i, r in enumerate(rows):
        r = r.withColumn("ord", F.lit(i))
        out = r if out is None else out.unionByName(r)
    return out


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "label",
                      model: str = "Baseline (majority)") -> DataFrame:
    """Most-frequent-class predictor fitted on ``train`` and scored on ``test``
    (M1). ROC-AUC of a constant score is 0.5."""
    top = train.groupBy(label).count().orderBy(F.col("count").desc(), F.col(label)).first()
    majority = top[label] if top is not None else 0
    scored = test.withColumn("_pred", F.lit(majority))
    return binary_metrics(scored, label, "_pred", None, model)


def student_t_p(t: float, dof: int) -> float:
    """Driver-side twin of the column expression (for tests and reports)."""
    if dof < 1 or t is None or math.isnan(t):
        return float("nan")
    theta = math.atan(abs(t) / math.sqrt(dof))
    c2 = math.cos(theta) ** 2
    if dof % 2 == 1:
        series, coef, power = 1.0, 1.0, 1.0
        for j in range(1, (dof - 1) // 2):
            coef *= 2 * j / (2 * j + 1)
            power *= c2
            series += coef * power
        a = 2 / math.pi * (theta + (math.sin(theta) * math.cos(theta) * series if dof > 1 else 0.0))
    else:
        series, coef, power = 1.0, 1.0, 1.0
        for j in range(1, dof // 2):
            coef *= (2 * j - 1) / (2 * j)
            power *= c2
            series += coef * power
        a = math.sin(theta) * series
    return 1.0 - a



KDE_GRID = 200


def gaussian_kde(df: DataFrame, col: str, grid_points: int = KDE_GRID) -> DataFrame:
    """Gaussian kernel density on an even grid from min to max with Scott's
    bandwidth ``h = sd(x, ddof=1) * n^(-1/5)`` (A24).

    Exact: every task adds its rows' contributions to the whole grid with numpy, equal values of a
    batch as one, and emits ``grid_points`` partial sums at its end, which one small aggregation adds
    up. Rows are neither shuffled nor expanded.
    """
    import numpy as np
    import pandas as pd

    x = F.col(col).cast("double")
    st = df.where(x.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sd"),
                                     F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    n, sd, mn, mx = st["n"], st["sd"], st["mn"], st["mx"]
    schema = "idx int, x double, density double"
    if not n or not sd:
        return df.sparkSession.createDataFrame([], schema)
    h = float(sd) * float(n) ** (-0.2)
    grid = np.linspace(mn, mx, grid_points)
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))

    def partial(it):
        total = np.zeros(grid_points)
        for pdf in it:
            v, c = np.unique(pdf["v"].to_numpy(dtype=float), return_counts=True)
            for a in range(0, len(v), 4096):
                z = (grid[:, None] - v[None, a:a + 4096]) / h
                total += np.exp(-0.5 * z * z) @ c[a:a + 4096]
        yield pd.DataFrame({"idx": np.arange(grid_points, dtype=np.int32), "s": total})

    parts = df.where(x.isNotNull()).select(x.alias("v")).mapInPandas(partial, "idx int, s double")
    sums = parts.groupBy("idx").agg(F.sum("s").alias("s"))
    return sums.select("idx", (F.lit(float(mn)) + F.col("idx") * F.lit(float((mx - mn) / (grid_points - 1))))
                       .alias("x"), (F.col("s") * F.lit(norm)).alias("density"))
