import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import profile
from trellis.operators.quantiles import exact_quantiles
from trellis.operators.split import stratum_quotas


def test_exact_quantiles_match_numpy_with_forced_refinement(spark):
    rnd = random.Random(3)
    vals = [rnd.lognormvariate(0, 2) for _ in range(20000)] + [5.0] * 7000  # a hot value
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    got = exact_quantiles(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.75, 1.0], accuracy=100, max_collect=500)
    for p in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0):
        assert math.isclose(got[("x", p)], float(np.quantile(vals, p)), rel_tol=1e-12)


def test_iqr_boundary_kept_null_not_outlier(spark):
    # q1 = 2, q3 = 4, iqr = 2 -> bounds [-1, 7]
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,), (7.0,), (None,), (7.5,)],
                               "x double")
    bounds = profile.iqr_bound_values(df, ["x"])
    lo, hi = bounds["x"][2], bounds["x"][3]
    kept = [r.x for r in profile.iqr_filter(df, ["x"]).collect()]
    assert None in kept
    assert all(v is None or lo <= v <= hi for v in kept)
    assert 7.5 not in kept or hi >= 7.5


def test_iqr_skips_binary_columns_on_request_only(spark):
    df = spark.createDataFrame([(float(i), 1 if i < 10 else 0) for i in range(100)], "x double, type int")
    assert profile.iqr_columns(df, None, skip_binary=True) == ["x"]
    assert profile.iqr_columns(df, None) == ["x", "type"]   # the rule cleans every numeric column


@pytest.mark.parametrize("n,p6,p7,p8", [(1599, 855, 217, 18), (4898, 3258, 1060, 180)])
def test_threshold_sensitivity_golden_counts(spark, n, p6, p7, p8):
    # positives at >= 6 / 7 / 8 of the raw rows, both published tables
    scores = [8] * p8 + [7] * (p7 - p8) + [6] * (p6 - p7) + [5] * (n - p6)
    df = spark.createDataFrame([(s,) for s in scores], "quality int")
    got = {r.threshold: (r.n_pos, r.n_neg) for r in profile.threshold_sensitivity(df).collect()}
    assert got == {6: (p6, n - p6), 7: (p7, n - p7), 8: (p8, n - p8)}
    pct = {r.threshold: r.pos_pct for r in profile.threshold_sensitivity(df).collect()}
    assert math.isclose(pct[7], p7 * 100.0 / n)


@pytest.mark.parametrize("counts,expect", [
    ({0: 1175, 1: 184}, {0: 235, 1: 37}),
    ({0: 3136, 1: 825}, {0: 628, 1: 165}),
    ({0: 4311, 1: 1009}, {0: 862, 1: 202}),
])
def test_split_quotas_reproduce_reference_tables(counts, expect):
    assert stratum_quotas(counts, 0.2) == expect


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    m = {(r.x, r.y): r.r for r in profile.corr_matrix(df).collect()}
    assert m[("a", "c")] is None and m[("c", "c")] is None
    assert math.isclose(m[("a", "b")], float(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1]))


def test_vif_uncentered_matches_regression_through_origin(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 3)) + np.array([3.0, 1.0, 0.0])
    x[:, 2] = x[:, 0] * 0.5 + rnd.normal(scale=0.1, size=500)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {r.feature: r.vif for r in profile.vif(df).collect()}
    for i, name in enumerate("abc"):
        y = x[:, i]
        others = np.delete(x, i, axis=1)
        beta, *_ = np.linalg.lstsq(others, y, rcond=None)
        r2 = 1 - ((y - others @ beta) ** 2).sum() / (y ** 2).sum()
        assert math.isclose(got[name], 1 / (1 - r2), rel_tol=1e-8)


def test_split_verification_checks_tolerance(spark):
    rows = [(0, "train")] * 90 + [(0, "test")] * 10 + [(1, "train")] * 10 + [(1, "test")] * 10
    df = spark.createDataFrame(rows, "label int, split string")
    out = {r["class"]: r for r in profile.split_verification(df, "label").collect()}
    assert out[0].train_n == 90 and out[1].test_n == 10
    assert out[0].within_tol is False


def test_polarity_flags_sign_flip(spark):
    # inside each group x rises with y, pooled it falls (Simpson)
    rows = [("g1", float(x), 1 if x > 5 else 0) for x in range(0, 10)]
    rows += [("g2", float(x) + 20, 1 if x > 5 else 0) for x in range(0, 10)]
    rows += [("g1", 50.0, 0)] * 40
    df = spark.createDataFrame(rows, "grp string, x double, label int")
    res = profile.polarity_check(df, "label", "grp", ["x"]).collect()
    assert len(res) == 2 and all(r.feature == "x" for r in res)
    assert any(r.sign_flip for r in res)


def test_vif_centered_matches_regression_with_intercept(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, 3)) + np.array([5.0, -2.0, 1.0])
    x[:, 1] = 0.8 * x[:, 0] + rnd.normal(scale=0.5, size=400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {r.feature: r.vif for r in profile.vif(df, centered=True).collect()}
    for i, name in enumerate("abc"):
        y = x[:, i]
        others = np.column_stack([np.ones(len(x)), np.delete(x, i, axis=1)])
        beta, *_ = np.linalg.lstsq(others, y, rcond=None)
        r2 = 1 - ((y - others @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        assert math.isclose(got[name], 1 / (1 - r2), rel_tol=1e-8)
