import os
import tempfile

from trellis.plans import run


def test_command_line_full_report(spark, tmp_path=None):
    folder = tempfile.mkdtemp(prefix="trellis-cli-")
    path = os.path.join(folder, "data.csv")
    with open(path, "w") as fh:
        fh.write("fixed acidity;alcohol;quality\n")
        for i in range(300):
            fh.write(f"{6 + (i % 7) * 0.3:.1f};{9 + (i % 11) * 0.4:.1f};{4 + (i * 7) % 5}\n")
    out = os.path.join(folder, "out")
    run.main(["classify", path, out, "--small", "--folds", "3", "--format", "csv"])
    for name in ("comparison", "threshold_sensitivity", "split_check", "t_test", "tuned_metrics",
                 "attribution_summary", "bundle_gbt", "learning_curve", "confusion_gradient_boosted_trees"):
        assert os.path.isdir(os.path.join(out, name)), name
    rows = spark.read.option("header", True).csv(os.path.join(out, "threshold_sensitivity")).collect()
    assert {int(r.threshold) for r in rows} == {6, 7, 8}


def _merged_csv(folder, name, n=240, with_type=True):
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write("fixed acidity,alcohol,quality" + (",type" if with_type else "") + "\n")
        for i in range(n):
            t = "red" if i % 3 == 0 else "white"
            row = f"{6 + (i % 7) * 0.3 + (0.5 if t == 'red' else 0):.1f},{9 + (i % 11) * 0.4:.1f},{4 + (i * 7) % 5}"
            fh.write(row + (f",{t}" if with_type else "") + "\n")
    return path


def test_command_line_other_entries(spark):
    folder = tempfile.mkdtemp(prefix="trellis-cli-")
    merged = _merged_csv(folder, "merged.csv")
    run.main(["score", merged, os.path.join(folder, "score"), "--small", "--folds", "3"])
    assert spark.read.parquet(os.path.join(folder, "score", "metrics")).count() == 1
    run.main(["type", merged, os.path.join(folder, "type"), "--small"])
    assert spark.read.parquet(os.path.join(folder, "type", "report")).count() == 5
    a = _merged_csv(folder, "a.csv", 150, with_type=False)
    b = _merged_csv(folder, "b.csv", 200, with_type=False)
    run.main(["combined", a, os.path.join(folder, "combined"), "--second", b, "--small", "--folds", "3"])
    assert spark.read.parquet(os.path.join(folder, "combined", "polarity")).count() == 4  # 2 features x 2 sources
    for name in ("t_test", "calibration", "learning_curve", "attribution_summary", "bundle_gbt", "report_txt"):
        assert os.path.isdir(os.path.join(folder, "combined", name)), name
