"""Second-order boosted trees against a direct search and a plain numpy fit."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import boosting, models
from trellis.operators.boosting import NewtonBoosting, NewtonBoostingModel


def _rows(spark, n=600, seed=0, weighted=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 8) ^ (rng.random(n) < 0.1)).astype(int)
    w = np.where(y == 1, 2.0, 1.0) if weighted else np.ones(n)
    df = spark.createDataFrame([(*map(float, r), int(t), float(v)) for r, t, v in zip(x, y, w)], "a double, b double, c double, label int, weight double")
    return models.assembler(["a", "b", "c"]).transform(df.repartition(5)), x, y, w


def _plain(x, y, w, rounds, depth, eta, reg=1.0, least=1.0):
    """The same trees by direct search, recursively, on the values themselves."""
    margin = np.zeros(len(y))

    def grow(rows, g, h, level, out):
        def leaf():
            out[rows] = -eta * g[rows].sum() / (h[rows].sum() + reg)
        best = None
        if level < depth:
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + reg)
            for f in range(x.shape[1]):
                for cut in np.unique(x[:, f]):
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if h[left].sum() >= least and h[right].sum() >= least:
                        gain = score(left) + score(right) - score(rows)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, left, right)
        if best is None:
            return leaf()
        grow(best[1], g, h, level + 1, out)
        grow(best[2], g, h, level + 1, out)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        grow(np.arange(len(y)), w * (p - y), w * p * (1 - p), 0, out)
        margin = margin + out
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("weighted", [False, True])
def test_probabilities_equal_a_direct_search(spark, monkeypatch, weighted):
    rows, x, y, w = _rows(spark, weighted=weighted)
    monkeypatch.setattr(boosting, "FLUSH", 2)         # margins are written between rounds
    model = NewtonBoosting(maxIter=5, maxDepth=3, stepSize=0.3, weightCol="weight" if weighted else None).fit(rows)
    got = model.transform(rows).select("a", "b", "c", "probability").collect()
    want = {tuple(v): p for v, p in zip(x, _plain(x, y, w, 5, 3, 0.3))}
    assert all(r.probability[1] == pytest.approx(want[(r.a, r.b, r.c)], abs=1e-9) for r in got)
    assert np.argmax(model.featureImportances.toArray()) in (0, 1)


def test_sums_in_two_stages_and_small_blocks_change_nothing(spark, monkeypatch):
    rows, *_ = _rows(spark)
    plain = NewtonBoosting(maxIter=3, maxDepth=3).fit(rows)
    monkeypatch.setattr(boosting, "DRIVER_SUMS", 1)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 7)
    again = NewtonBoosting(maxIter=3, maxDepth=3).fit(rows)
    a, b = (sorted((tuple(r.features), round(r.probability[1], 9)) for r in m.transform(rows).collect()) for m in (plain, again))
    assert a == b


def test_pipeline_is_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from trellis.operators.preparation import Preparation
    rows, *_ = _rows(spark)
    df = rows.drop("features").withColumn("k", F.monotonically_increasing_id())
    model = Preparation("k", "label", ["a", "b", "c"], weight="positive").model(
        models.boosted_trees(3, 3, 0.3, "label", "weight", booster="newton"))(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(again.stages[-1], NewtonBoostingModel)
    a, b = (models.score(m, df, "label", ["k"]).orderBy("k").collect() for m in (model, again))
    assert a == b and {r.prediction for r in a} <= {0, 1}


def test_rows_of_one_class_give_a_constant(spark):
    rows, *_ = _rows(spark)
    model = NewtonBoosting(maxIter=2, maxDepth=2).fit(rows.where("label = 1"))
    p = {round(r.probability[1], 9) for r in model.transform(rows).collect()}
    assert len(p) == 1 and p.pop() > 0.5


def test_missing_features_and_no_rows_are_errors(spark):
    rows, *_ = _rows(spark)
    with pytest.raises(ValueError):
        NewtonBoosting().fit(rows.where("false"))
    with pytest.raises(Exception, match="impute"):
        bad = models.assembler(["a"], "v", "keep").transform(rows.withColumn("a", F.when(F.col("b") > 3, F.col("a"))))
        NewtonBoosting(featuresCol="v", maxIter=1).fit(bad)
    with pytest.raises(ValueError):
        models.boosted_trees(booster="other")


def test_cells_give_the_same_trees(spark, monkeypatch):
    from trellis.operators import boosting
    df = spark.range(0, 4000, 1, 4).select(
        F.pmod(F.xxhash64("id"), F.lit(9)).cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("double").alias("b"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)).alias("e"))
    df = df.withColumn("label", (F.col("a") + F.col("b") + F.col("e") > 10).cast("int")).withColumn("weight", 1.0 + F.col("label"))
    df = models.assembler(["a", "b"]).transform(df)

    def fit():
        model = models.boosted_trees(5, 3, 0.3, "label", "weight", booster="newton").fit(df)
        return json.loads(model.getOrDefault(model.trees))
    whole = fit()
    monkeypatch.setattr(boosting, "ROWS", 100)
    written = []
    plain = boosting.cut_lineage
    monkeypatch.setattr(boosting, "cut_lineage", lambda t, name: written.append(plain(t, name)) or written[-1])
    by_cells = fit()
    assert written[0].agg(F.sum("n")).first()[0] <= 9 * 5 * 2      # blocks of cells, not of 4000 rows
    for a, b in zip(whole, by_cells):
        assert a["levels"] == b["levels"]
        assert np.allclose(a["leaves"], b["leaves"], atol=1e-9)
