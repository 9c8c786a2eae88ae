from pyspark.sql import functions as F

from trellis.plans import workflow


def test_classification_workflow_smoke(spark):
    rows = [(f"k{i}", 1 if (i * 7) % 10 < 3 else 0, float(i % 13), float((i * 3) % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, label int, a double, b double")
    res = workflow.classification(df, "k", "label", ["a", "b"], workflow.ModelSizes.small())
    rows = res.comparison.collect()
    assert [r.model for r in rows][0].startswith("Baseline")
    assert len(rows) == 4 and all(0.0 <= r.accuracy <= 1.0 for r in rows)
    check = {r["class"]: r for r in res.split_check.collect()}
    assert all(r.within_tol for r in check.values())
    test_n = sum(r.test_n for r in check.values())
    assert test_n == 120


def test_full_report_tables(spark):
    rows = [(float(i % 13), float((i * 3) % 7), 5 + (i * 7) % 4) for i in range(500)]
    raw = spark.createDataFrame(rows, "a double, b double, quality int")
    from trellis.operators import prep
    labelled = prep.binary_label(raw, "quality", "target", 7)
    out = workflow.full_report(labelled.drop("quality"), "target", ["a", "b"],
                               sizes=workflow.ModelSizes.small(), cv_folds=3, learning_folds=2)
    for name in ("comparison", "split_check", "vif", "tuned_metrics", "calibration", "roc_curve",
                 "t_test", "cv_box", "attribution_summary", "local_explanation", "learning_curve",
                 "confusion_random_forest", "confusion_logistic_regression"):
        assert out[name].count() > 0, name
    t = out["t_test"].first()
    assert t.n == 3 and t.reliable is False


def test_classification_with_tuning(spark):
    rows = [(f"k{i}", 1 if (i * 7) % 10 < 3 else 0, float(i % 13), float((i * 3) % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, label int, a double, b double")
    res = workflow.classification(df, "k", "label", ["a", "b"], workflow.ModelSizes.small(),
                                  learners=("rf", "gbt"), tune=True,
                                  rf_grid={"numTrees": [5], "maxDepth": [3, 4], "min_samples_split": [5]},
                                  gbt_grid={"maxIter": [3], "maxDepth": [2], "stepSize": [0.1]})
    assert [r.model for r in res.comparison.collect()] == ["Random Forest", "Gradient Boosted Trees"]


def test_classification_with_smote(spark):
    rows = [(f"k{i}", 1 if (i * 7) % 10 < 2 else 0, float(i % 13), float((i * 3) % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, label int, a double, b double")
    res = workflow.classification(df, "k", "label", ["a", "b"], workflow.ModelSizes.small(),
                                  learners=("lr", "rf"), resample="smote", iqr=False)
    assert len(res.comparison.collect()) == 2


def test_pooled_sources_keep_rare_marker(spark):
    # the marker's rarer value is 20 % of the rows: an IQR rule on it would
    # remove that whole source
    big = spark.createDataFrame([(1 if i % 4 == 0 else 0, float(i), float(i % 7)) for i in range(400)],
                                "label int, a double, b double")
    small = spark.createDataFrame([(1 if i % 4 == 0 else 0, i + 0.5, float(i % 5)) for i in range(100)],
                                  "label int, a double, b double")
    out = workflow.combined([big, small], [0, 1], "row_key", "label", ["a", "b"],
                            sizes=workflow.ModelSizes.small(), group_check=False)
    assert len(out["comparison"].collect()) == 2
    from trellis.operators import prep, profile
    pooled = prep.union_sources([big, small], marker="type", markers=[0, 1])
    assert profile.binary_columns(pooled, ["a", "b", "type"]) == {"type"}
    # with the marker in the IQR rule the rare source would vanish
    assert profile.iqr_filter(pooled, ["type"]).where("type = 1").count() == 0
    assert profile.iqr_filter(pooled, ["a", "b"]).where("type = 1").count() > 0
