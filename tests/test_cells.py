"""Tree learners on cells: the same trees as row by row, whole bootstraps, a model that Spark saves and loads."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import functions as F

from trellis.operators import cells, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double")
    df = spark.range(0, 6000, 1, 4).select("id", h(1, 9).alias("a"), h(2, 5).alias("b"), (h(3, 7) / 3).alias("c"), h(4, 10).alias("e"))
    df = df.withColumn("label", (F.col("a") + 2 * F.col("b") + F.col("e") > 12).cast("int")) \
        .withColumn("score", F.col("a") + F.col("e")).withColumn("weight", F.when(F.col("label") == 1, 2.5).otherwise(1.0))
    return models.assembler(FEATURES).transform(df).cache()


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(cells, "ROWS", 100)


def probabilities(model, rows):
    return np.array([r[0] for r in models.probability_column(model.transform(rows)).orderBy("id").select("p1").collect()])


def test_boosted_trees_equal_spark(spark, rows, small):
    ours = models.boosted_trees(6, 4, 0.2, "label", "weight").fit(rows)
    theirs = GBTClassifier(labelCol="label", weightCol="weight", maxIter=6, maxDepth=4, stepSize=0.2, seed=42).fit(rows)
    assert np.allclose(probabilities(ours, rows), probabilities(theirs, rows), atol=1e-9)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)
    assert ours.getOrDefault("weightCol") == "weight"


def test_one_tree_equals_spark(spark, rows, small):
    """Without a bootstrap and with all features a tree has no randomness."""
    args = dict(numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=9, minInstancesPerNode=4, labelCol="label",
                weightCol="weight", seed=1)
    ours, theirs = cells.CellForestClassifier(**args).fit(rows), RandomForestClassifier(**args).fit(rows)
    assert ours.trees[0].toDebugString.split("\n")[1:] == theirs.trees[0].toDebugString.split("\n")[1:]
    assert np.allclose(probabilities(ours, rows), probabilities(theirs, rows), atol=1e-9)


def test_forest_close_to_spark_saved_and_loaded(spark, rows, small, tmp_path):
    ours = models.random_forest(40, 30, 5, "label", "weight").fit(rows)
    theirs = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=40, maxDepth=30, featureSubsetStrategy="sqrt",
                                    minInstancesPerNode=3, seed=3).fit(rows)
    p, q = probabilities(ours, rows), probabilities(theirs, rows)
    assert np.sqrt(((p - q) ** 2).mean()) < 0.05 and abs(p.mean() - q.mean()) < 0.01
    ours.write().save(str(tmp_path / "m"))
    again = RandomForestClassificationModel.load(str(tmp_path / "m"))
    assert again.getNumTrees == 40 and np.array_equal(probabilities(again, rows), p)


def test_regressor(spark, rows, small):
    model = models.rf_regressor(20, "score").fit(rows)
    assert model.transform(rows).select(F.abs(F.avg(F.col("prediction") - F.col("score")))).first()[0] < 0.05
    rmse = model.transform(rows).select(F.sqrt(F.avg((F.col("prediction") - F.col("score")) ** 2))).first()[0]
    assert 2.0 < rmse < 2.95     # the noise is uniform on 0..9: deviation 2.87


def test_bootstrap_draws_rows():
    """A cell of n rows is drawn Poisson(n) times: the root's rows vary like a bootstrap of rows, not of cells."""
    bins, n = np.zeros((1, 1), np.uint16), np.array([10_000])
    raw = [int(cells.grow(t, 5, bins, np.zeros(1), np.ones(1), n, [[0.5]], 2, 3, 1, 0.0, 1, True)["raw"][0]) for t in range(200)]
    assert abs(np.mean(raw) - 10_000) < 30 and 80 < np.std(raw) < 120


def test_large_parts_are_not_written_row_by_row(spark, rows, small, monkeypatch):
    from trellis.operators.preparation import FittedPreparation, Preparation
    monkeypatch.setattr(FittedPreparation, "assembled", lambda *a: pytest.fail("written"))
    plain = rows.drop("features", "weight")
    model = Preparation("id", "label", FEATURES, weight="balanced").model(models.random_forest(5, 4, 2, "label", "weight"))(plain)
    assert model.transform(plain).count() == 6000


def test_boosted_rounds_take_no_job_a_level(spark, rows, small, monkeypatch):
    """All rounds are grown in one task: Spark's own learner is asked for a single stump, and the trees are its trees."""
    asked = []
    learn = cells.CellTrees._learn
    monkeypatch.setattr(cells.CellTrees, "_learn", lambda self, *a, **k: asked.append(k) or learn(self, *a, **k))
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "rounds")
    try:
        model = models.boosted_trees(60, 6, 0.1, "label", "weight").fit(rows)
        jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert asked == [{"maxDepth": 0, "maxIter": 1}] and 0 < jobs < 60
    assert model.getNumTrees == 60 and model.treeWeights == [1.0] + [0.1] * 59


def test_more_cells_than_a_task_boosts(spark, rows, small, monkeypatch):
    few = models.boosted_trees(4, 3, 0.2, "label", "weight").fit(rows)
    monkeypatch.setattr(cells, "BOOST_CELLS", 10)
    many = models.boosted_trees(4, 3, 0.2, "label", "weight").fit(rows)
    assert np.allclose(probabilities(few, rows), probabilities(many, rows), atol=1e-9)


def test_bins_count_the_cuts_below(spark):
    cuts = [[-1.5, 0.0, 2.0], [], [0.5, float("inf")]]
    values = [None, float("nan"), float("-inf"), -1.5, -1.0, -0.0, 0.0, 1e-300, 2.0, 2.5, float("inf")]
    x = spark.createDataFrame([(v, v, v) for v in values], "x0 double, x1 double, x2 double")
    got = [tuple(r) for r in cells.binned(x, cuts).select("b0", "b1", "b2").collect()]
    want = x.select(*[cells._bin(F.col(f"x{i}"), c) for i, c in enumerate(cuts)]).collect()
    assert got == [tuple(r) for r in want]
    assert [g[0] for g in got] == [3, 3, 0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_cuts_of_parts_are_those_of_their_rows(spark):
    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double")
    rows = spark.range(0, 5000, 1, 3).select(F.array(h(1, 5), h(2, 40), h(3, 3000)).alias("x"), h(4, 3).alias("f"))
    conditions = [F.col("f") != 0, F.col("f") != 1, F.lit(False)]
    assert cells.part_cuts(rows, 3, 32, conditions) == [cells.bin_cuts(rows.where(c), 3, 32) for c in conditions]
    assert [len(c) for c in cells.bin_cuts(rows, 3, 32)] == [4, 31, 31]


@pytest.fixture(scope="module")
def folded(spark):
    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double")
    df = spark.range(0, 9000, 1, 4).select("id", (h(1, 5000) / 7).alias("a"), h(2, 3).alias("b"), F.lit(1.5).alias("c"), h(3, 4).alias("e"))
    return df.select("id", *FEATURES, (F.floor(F.col("a") / 200) + F.col("b") + F.col("e")).cast("double").alias("score"),
                     h(4, 3).cast("int").alias("fold")).cache()


def one_by_one(pipe, folded, k):
    out = []
    for f in range(k):
        pred = pipe.fit(folded.where(F.col("fold") != f)).transform(folded.where(F.col("fold") == f))
        out.append(pred.agg(F.sqrt(F.avg((F.col("score") - F.col("prediction")) ** 2))).first()[0])
    return out


def test_folds_together_equal_folds_one_by_one(spark, folded, small):
    from pyspark.ml import Pipeline
    pipe = Pipeline(stages=[models.assembler(FEATURES), models.rf_regressor(5, "score", max_depth=4)])
    got = models.cv_regression_scores(pipe, folded, "fold", 3, "m", "score").orderBy("fold").collect()
    assert [(r["model"], r["fold"]) for r in got] == [("m", 0), ("m", 1), ("m", 2)]
    assert np.allclose([r["score"] for r in got], one_by_one(pipe, folded, 3), atol=1e-9)


def test_folds_read_the_rows_a_fixed_number_of_times(spark, folded, small, monkeypatch):
    """Every fold learns from cells that were summed for all folds; no fold's own rows are binned again."""
    tables = []
    table = cells.cell_table
    monkeypatch.setattr(cells, "cell_table", lambda *a: tables.append(a[2:]) or table(*a))
    from pyspark.ml import Pipeline
    pipe = Pipeline(stages=[models.assembler(FEATURES), models.rf_regressor(3, "score", max_depth=3)])
    assert models.cv_regression_scores(pipe, folded, "fold", 3, "m", "score").count() == 3
    assert tables == [("fold",)]


def test_folds_without_saving_learn_from_rows(spark, folded, small, monkeypatch):
    from pyspark.ml import Pipeline
    monkeypatch.setattr(cells.CellForestRegressor, "_most_cells", 3)
    pipe = Pipeline(stages=[models.assembler(FEATURES), models.rf_regressor(3, "score", max_depth=3)])
    got = models.cv_regression_scores(pipe, folded, "fold", 3, "m", "score").orderBy("fold").collect()
    assert np.allclose([r["score"] for r in got], one_by_one(pipe, folded, 3), atol=1e-9)


def test_folds_need_labels(spark, folded, small):
    bad = folded.withColumn("score", F.when(F.col("id") != 17, F.col("score")))     # one row without
    with pytest.raises(ValueError, match="label"):
        models.cv_regression_scores(models.rf_regressor(2, "score", max_depth=2), models.assembler(FEATURES).transform(bad),
                                    "fold", 3, "m", "score")
