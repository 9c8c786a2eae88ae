"""Results must not depend on partitioning (1, 4, 37 partitions)."""

import random

from pyspark.sql import functions as F

from trellis.operators import curves, metrics, profile
from trellis.operators.quantiles import exact_quantiles


def _scored(spark, parts):
    rnd = random.Random(11)
    rows = [(i, 1 if rnd.random() < 0.25 else 0, round(rnd.random(), 3)) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, label int, s double").repartition(parts)


def test_curves_and_metrics_partition_invariant(spark):
    res = []
    for parts in (1, 4, 37):
        df = _scored(spark, parts)
        roc = sorted((tuple(r) for r in curves.roc_curve(df, "label", "s").collect()),
                     key=lambda t: (t[0] is not None, t[0] or 0.0, t[1], t[2]))
        pr = sorted(tuple(r) for r in curves.pr_curve(df, "label", "s").collect())
        # double sums may differ in the last bit with the summation order
        cal = sorted((r.bin, r.n, round(r.mean_predicted, 12), round(r.fraction_positive, 12))
                     for r in curves.calibration_bins(df, "label", "s").collect())
        auc = curves.roc_auc_value(df, "label", "s")
        q = exact_quantiles(df, ["s"], [0.1, 0.5, 0.9], accuracy=50, max_collect=200)
        iqr = profile.iqr_filter(df, ["s"]).count()
        res.append((roc, pr, cal, auc, q, iqr))
    assert res[0] == res[1] == res[2]


def test_single_class_auc_falls_back_to_half(spark):
    df = spark.createDataFrame([(0, 0.2, 0), (0, 0.7, 1)], "label int, s double, prediction int")
    assert metrics.binary_metrics(df, "label", "prediction", "s").first().roc_auc == 0.5
