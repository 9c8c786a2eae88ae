import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import curves, metrics

# confusion counts recovered from the reference's published metric rows
GOLDEN = [
    ("red LR", 34, 68, 3, 167, 0.7390, 0.3333, 0.9189, 0.4892),
    ("red RF", 19, 25, 18, 210, 0.8419, 0.4318, 0.5135, 0.4691),
    ("red boosted", 22, 23, 15, 212, 0.8603, 0.4889, 0.5946, 0.5366),
    ("white LR", 129, 168, 36, 460, 0.7427, 0.4343, 0.7818, 0.5584),
    ("white RF", 113, 96, 52, 532, 0.8134, 0.5407, 0.6848, 0.6043),
    ("white boosted", 121, 131, 44, 497, 0.7793, 0.4802, 0.7333, 0.5803),
    ("combined RF", 56, 21, 146, 841, 0.8430, 0.7273, 0.2772, 0.4014),
    ("combined boosted", 142, 142, 60, 720, 0.8102, 0.5000, 0.7030, 0.5844),
    ("majority", 0, 0, 37, 235, 0.8640, 0.0, 0.0, 0.0),
]


def _scored(spark, tp, fp, fn, tn):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
    return spark.createDataFrame(rows, "label int, prediction int")


@pytest.mark.parametrize("name,tp,fp,fn,tn,acc,prec,rec,f1", GOLDEN)
def test_golden_metric_rows(spark, name, tp, fp, fn, tn, acc, prec, rec, f1):
    r = metrics.binary_metrics(_scored(spark, tp, fp, fn, tn)).first()
    assert round(r.accuracy, 4) == acc and round(r.precision, 4) == prec
    assert round(r.recall, 4) == rec and round(r.f1, 4) == f1
    assert r.roc_auc == 0.5


def _random_scores(n=2000, seed=1, ties=True):
    rnd = random.Random(seed)
    ys, ss = [], []
    for _ in range(n):
        y = 1 if rnd.random() < 0.3 else 0
        s = rnd.random() * 0.6 + 0.3 * y
        ss.append(round(s, 2) if ties else s)
        ys.append(y)
    return ys, ss


def _brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_equals_mann_whitney(spark):
    ys, ss = _random_scores(600)
    df = spark.createDataFrame(list(zip(ys, ss)), "label int, s double").repartition(5)
    assert math.isclose(curves.roc_auc_value(df, "label", "s"), _brute_auc(ys, ss), rel_tol=1e-12)


def _sk_roc(ys, ss):
    """sklearn's roc_curve with drop_intermediate, re-derived."""
    order = np.argsort(-np.array(ss), kind="mergesort")
    s = np.array(ss)[order]
    y = np.array(ys)[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = (1 + idx) - tps
    thr = s[idx]
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    return list(zip(thr, fps / fps[-1], tps / tps[-1]))


def test_roc_curve_matches_reference_algorithm(spark):
    ys, ss = _random_scores(1500, ties=True)
    df = spark.createDataFrame(list(zip(ys, ss)), "label int, s double").repartition(3)
    got = sorted((r.threshold, r.fpr, r.tpr) for r in curves.roc_curve(df, "label", "s").collect()
                 if r.threshold is not None)
    want = sorted((float(t), float(f), float(p)) for t, f, p in _sk_roc(ys, ss))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a, b))


def test_best_threshold_lowest_on_ties_and_f1_zero_division(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "label int, s double")
    bt = curves.best_threshold(df, "label", "s").first()
    pr = {r.threshold: r for r in curves.pr_curve(df, "label", "s").collect()}
    assert bt.f1 == max(r.f1 for r in pr.values())
    assert bt.threshold == min(t for t, r in pr.items() if r.f1 == bt.f1)
    none_pos = spark.createDataFrame([(0, 0.3), (0, 0.2)], "label int, s double")
    assert all(r.f1 == 0.0 for r in curves.pr_curve(none_pos, "label", "s").collect())


def test_calibration_right_closed_bins(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 0.1000001), (0, 1.0), (1, 0.3)], "label int, s double")
    bins = {r.bin: r.n for r in curves.calibration_bins(df, "label", "s").collect()}
    # 0.0 and 0.1 in bin 0 (0.1 is the right edge), 0.1000001 in bin 1, 1.0 in bin 9
    assert bins[0] == 2 and bins[1] == 1 and bins[9] == 1


def test_t_test_p_value_closed_form():
    # t = 2.262157 with 9 degrees of freedom is the 0.975 quantile -> p = 0.05
    assert math.isclose(metrics.student_t_p(2.2621571627, 9), 0.05, abs_tol=1e-8)
    # df = 1 is Cauchy: p = 1 - 2/pi * atan(t)
    assert math.isclose(metrics.student_t_p(1.0, 1), 0.5, abs_tol=1e-12)
    # df = 4: t = 2.776445 is the 0.975 quantile
    assert math.isclose(metrics.student_t_p(2.7764451052, 4), 0.05, abs_tol=1e-8)


def test_paired_t_test_column_expression_matches_driver(spark):
    rows = [("a", f, 0.5 + 0.01 * f) for f in range(10)] + [("b", f, 0.48 + 0.013 * f * (f % 3)) for f in range(10)]
    df = spark.createDataFrame(rows, "model string, fold int, score double")
    r = metrics.paired_t_test(df, "a", "b").first()
    d = np.array([0.5 + 0.01 * f - (0.48 + 0.013 * f * (f % 3)) for f in range(10)])
    t = d.mean() / (d.std(ddof=1) / math.sqrt(10))
    assert math.isclose(r.t_stat, t, rel_tol=1e-9)
    assert math.isclose(r.p_value, metrics.student_t_p(t, 9), rel_tol=1e-9)
    assert r.reliable


def test_classification_report_multiclass(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 2), (2, 0), (2, 2)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    rep = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert rep["2"].precision == 1.0 and math.isclose(rep["2"].recall, 2 / 3)
    assert math.isclose(rep["accuracy"].f1, 4 / 6) and rep["macro avg"].support == 6


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, 3.5)], "actual double, predicted double")
    r = metrics.regression_metrics(df).first()
    e = np.array([-0.5, 0.5, -0.5])
    assert math.isclose(r.mse, (e ** 2).mean()) and math.isclose(r.mae, 0.5)
    assert math.isclose(r.r2, 1 - (e ** 2).sum() / 2.0)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in range(31)], "e double")
    h = metrics.histogram(df, "e", 30).collect()
    assert len(h) == 30 and sum(r.n for r in h) == 31 and h[-1].n == 2


def test_calibration_summary(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.3)], "label int, s double")
    r = curves.calibration_summary(df, "label", "s").first()
    assert math.isclose(r.brier, (0.01 + 0.01 + 0.04 + 0.09) / 4)
    assert r.ece >= 0.0


def test_threshold_predict_inclusive_and_residual(spark):
    from trellis.operators import prep
    df = spark.createDataFrame([(0.5, 2.0, 1.5), (0.4999, 1.0, 1.5)], "p double, y double, yhat double")
    got = [(r.pred, r.res) for r in df.select(prep.threshold_predict("p", 0.5).alias("pred"),
                                               prep.residual("y", "yhat").alias("res")).collect()]
    assert got == [(1, 0.5), (0, -0.5)]


def test_joint_counts_shared_range(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0), (10.0, 0.0)], "actual double, predicted double")
    cells = {(r.bin_x, r.bin_y): r.n for r in metrics.joint_counts(df, "actual", "predicted", 10).collect()}
    assert cells == {(0, 0): 1, (9, 9): 1, (9, 0): 1}


def test_split_report_strings(spark):
    from trellis.functions.report import split_report
    from trellis.operators import profile
    rows = [(0, "train")] * 3 + [(0, "test")] + [(1, "train")] + [(1, "test")]
    chk = profile.split_verification(spark.createDataFrame(rows, "label int, split string"), "label")
    rep = {r["class"]: r for r in split_report(chk).collect()}
    assert rep[0]["Train %"] == "75.00%" and rep[0]["Test %"] == "50.00%" and rep[0]["Diff (pp)"] == "25.00"


def test_curves_of_scores_in_a_narrow_range_over_many_ranges(spark):
    """All scores in [0.5, 0.5001], one held by a third of the rows: every range has its share and the
    curve is the one of a single pass."""
    rng = np.random.default_rng(8)
    s = 0.5 + rng.integers(0, 4000, 6000) * 2.5e-8
    s[::3] = 0.50005
    y = (rng.random(6000) < 0.3).astype(int)
    df = spark.createDataFrame(list(zip(map(int, y), map(float, s))), "label int, s double").repartition(7)
    cum, P, N = curves.score_counts(df, "label", "s", parts=13)
    got = cum.orderBy(F.col("score").desc()).toPandas()
    values = np.unique(s)[::-1]
    pos = np.array([y[s == v].sum() for v in values])
    neg = np.array([(1 - y[s == v]).sum() for v in values])
    assert (P, N) == (y.sum(), 6000 - y.sum())
    assert np.array_equal(got.score, values) and np.array_equal(got.tps, pos.cumsum()) and np.array_equal(got.fps, neg.cumsum())
    assert np.array_equal(got.next_pos[:-1].astype(int), pos[1:]) and np.isnan(got.next_neg.iloc[-1])
    # one range exchange after the distinct scores, and none for the curve itself
    plan = cum._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 0 and "Window" not in plan
