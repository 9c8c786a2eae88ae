"""Edge cases from the fixture list: empty input, single class, constant
column, tiny minority class."""

from pyspark.sql import functions as F

from trellis.operators import curves, metrics, prep, profile, split
from trellis.operators.quantiles import exact_quantiles
from trellis.operators.resample import smote


def _empty(spark):
    return spark.createDataFrame([], "k long, label int, s double, x double, quality int")


def test_empty_input(spark):
    df = _empty(spark)
    assert exact_quantiles(df, ["x"], [0.5])[("x", 0.5)] is None
    assert profile.iqr_filter(df, ["x"]).count() == 0
    t = {r.threshold: r for r in profile.threshold_sensitivity(df).collect()}
    assert t[7].n_pos == 0 and t[7].pos_pct is None
    assert split.stratified_split(df, "k", "label").count() == 0
    s = prep.dedup_summary(df).first()
    assert (s.initial_rows, s.final_rows) == (0, 0)
    c = metrics.confusion_counts(df.withColumn("prediction", F.lit(0))).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (0, 0, 0, 0)
    assert curves.roc_auc_value(df, "label", "s") is None
    assert curves.roc_curve(df, "label", "s").count() == 1   # the origin only


def test_single_class_curves(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (0, 0.4)], "label int, s double")
    roc = [r for r in curves.roc_curve(df, "label", "s").collect() if r.threshold is not None]
    assert all(r.tpr is None for r in roc)          # no positives: tpr undefined
    pr = curves.pr_curve(df, "label", "s").collect()
    assert all(r.recall == 1.0 and r.f1 == 0.0 for r in pr)


def test_constant_column_iqr_and_vif(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(20)], "c double, x double")
    assert profile.iqr_filter(df, ["c"]).count() == 20    # iqr 0: equal values stay
    v = {r.feature: r.vif for r in profile.vif(df, ["c", "x"]).collect()}
    assert v["c"] > 1.0 and v["x"] > 1.0


def test_smote_with_fewer_than_six_minority_rows(spark):
    rows = [(f"m{i}", 0, float(i), float(i % 3)) for i in range(30)]
    rows += [("a", 1, 0.0, 0.0), ("b", 1, 1.0, 0.0), ("c", 1, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, y int, a double, b double")
    out = smote(df, "k", "y", ["a", "b"])
    counts = {(r.y, r.synthetic): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert counts[(1, True)] == 27 and counts[(0, False)] == 30


def test_smote_single_minority_row_is_left_alone(spark):
    rows = [(f"m{i}", 0, float(i), 0.0) for i in range(5)] + [("a", 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, y int, a double, b double")
    assert smote(df, "k", "y", ["a", "b"]).where("synthetic").count() == 0
