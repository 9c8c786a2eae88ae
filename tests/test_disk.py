"""What splits, written tables and fold loops leave on disk."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from trellis.operators import split
from trellis.session import cut_lineage, forget


def _hash(key, seed=42):
    return hashlib.md5(f"{chr(0) if key is None else key}:{seed}".encode()).hexdigest()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeats", [1, 7])
def test_split_takes_first_rows_in_hash_order_without_a_shuffle(spark, repeats):
    rows = [(None if i % 50 == 49 else f"k{i // repeats}", i % 3 if i % 11 else None, i) for i in range(700)]
    df = cut_lineage(spark.createDataFrame(rows, "k string, y int, v int"), "rows")
    got = split.stratified_split(df, "k", "y")
    counts = {c: sum(r[1] == c for r in rows) for c in {r[1] for r in rows}}
    for c, quota in split.stratum_quotas(counts).items():
        mine = [(_hash(r[0]), r[2]) for r in rows if r[1] == c]
        test = {r.v for r in got.where((F.col("split") == "test") & F.col("y").eqNullSafe(F.lit(c))).collect()}
        last = sorted(h for h, _ in mine)[quota - 1]
        assert len(test) == quota
        assert {v for h, v in mine if h < last} <= test <= {v for h, v in mine if h <= last}
    assert got.count() == 700 and got.columns == ["k", "y", "v", "split"]
    one = split.random_split(df, "k")
    first = sorted(_hash(r[0]) for r in rows)[:140]
    assert sorted(_hash(r.k) for r in one.where("split = 'test'").collect()) == first
    if repeats == 1:
        unique = df.where("k is not null")
        assert "Exchange" not in _plan(split.stratified_split(unique, "k", "y"))
        assert "Exchange" not in _plan(split.random_split(unique, "k"))


def test_split_of_repeated_composite_keys(spark):
    df = cut_lineage(spark.createDataFrame([(i // 9, "a", i % 2) for i in range(90)], "k int, l string, y int"), "rows")
    got = split.stratified_split(df, ["k", "l"], "y")
    assert sorted((r.y, r.split, r["count"]) for r in got.groupBy("y", "split").count().collect()) == [
        (0, "test", 9), (0, "train", 36), (1, "test", 9), (1, "train", 36)]


def _shuffle_files(spark) -> set:
    tops = {os.path.dirname(str(f)) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()}
    return {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_shuffles_of_a_written_table_go_with_its_end(spark):
    import time
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffle_files(spark), spark.conf.get(key)
    t = cut_lineage(spark.range(20_000).repartition(4, "id").groupBy((F.col("id") % 5000).alias("g")).count(), "sums")
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and spark.conf.get(key) == setting
    assert t.agg(F.sum("count")).first()[0] == 20_000
    folder = t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    forget(t)
    assert not os.path.exists(folder)


def test_folds_travel_without_their_hash(spark):
    df = cut_lineage(spark.createDataFrame([(f"k{i}", i % 2) for i in range(300)], "k string, y int"), "rows")
    folded = split.stratified_kfold(df, "k", "y", k=3)
    want = {}
    for c in (0, 1):
        for n, i in enumerate(sorted((i for i in range(300) if i % 2 == c), key=lambda i: _hash(f"k{i}"))):
            want[f"k{i}"] = n % 3
    assert {r.k: r.fold for r in folded.collect()} == want
    exchange = folded._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(exchange) == 2 and "md5" not in exchange[1].replace("conv(substring(md5", "")


def _labelled(spark, n, k):
    rows = [(f"k{i}", int((i * 7 + i // 5) % 10 < 4), float(i % 3), float((i * i) % 5), float(i // 7 % 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, y int, a double, b double, c double")
    return cut_lineage(split.stratified_kfold(df, "k", "y", k=k), "folds")


def test_grid_search_reads_cells_and_keeps_no_fold(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.tuning import CrossValidator

    from trellis.operators import cells, models
    monkeypatch.setattr(cells, "ROWS", 400)
    folded = models.with_positive_weight(_labelled(spark, 2500, 2), "y", 1.5)
    stages, est = [models.assembler(["a", "b", "c"])], models.boosted_trees(2, 2, 0.1, "y", "weight")
    grid = {"maxDepth": [1, 2]}
    cv = CrossValidator(estimator=Pipeline(stages=[*stages, est]), estimatorParamMaps=models.param_grid(est, grid),
                        evaluator=models.PositiveF1Evaluator("y"), foldCol="fold", numFolds=2).fit(folded)
    monkeypatch.setattr(models, "CrossValidator", lambda **_: pytest.fail("rows of every fold were kept"))
    best, table = models.grid_search(stages, est, grid, folded, "fold", 2, "y")
    assert [r.mean_f1 for r in table.collect()] == pytest.approx(cv.avgMetrics, abs=1e-12)
    assert best.stages[-1].getMaxDepth() == cv.bestModel.stages[-1].getMaxDepth()


def test_learning_curve_reads_the_rows_once_a_fold(spark, monkeypatch):
    from trellis.operators import cells, models
    from trellis.operators.preparation import WEIGHT, Preparation
    monkeypatch.setattr(cells, "ROWS", 400)
    folded = _labelled(spark, 1500, 2).withColumn("a", F.when(F.col("a") != 1, F.col("a")))
    model = Preparation("k", "y", ["a", "b", "c"], weight="balanced").model(models.random_forest(3, 3, 5, "y", WEIGHT))
    got = models.learning_curve(model, folded, "k", 2, "y").collect()
    # a bare function is fitted subset by subset; the forest then reads the cells of each
    want = models.learning_curve(lambda part: model(part), folded, "k", 2, "y").collect()
    # smaller subsets are Spark's own draws of rows
    large = [(r, w) for r, w in zip(got, want) if r.mean_train_size > 400]
    assert len(got) == 5 and len(large) == 3 and all(tuple(r) == pytest.approx(tuple(w), abs=1e-12) for r, w in large)
    calls = []
    plain = type(model).__call__
    monkeypatch.setattr(type(model), "__call__", lambda self, part: calls.append(part.count()) or plain(self, part))
    models.learning_curve(model, folded, "k", 2, "y")
    assert calls and max(calls) <= 400


def test_fold_queries_leave_only_their_folds(spark, tmp_path):
    from trellis.plans import catalogue
    rows = [(i, 1, float(1 + i * 7 % 50), 900.0 + i, float(i % 5) / 100, float(i % 3) / 100, "O") for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                                "l_tax double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    from trellis import session
    known = set(session._WRITTEN)
    folded = catalogue._folded(spark, str(tmp_path), 4)
    assert folded.count() == 320 and folded.columns == ["row_key", "label", *catalogue.MODEL_FEATURES, "fold"]
    left = [p for p in set(session._WRITTEN) - known if os.path.exists(p.removeprefix("file:"))]
    assert len(left) == 1 and "folds-" in left[0]


def test_scratch_tables_go(spark):
    from trellis.session import scratch
    with scratch(spark) as keep_table:
        gone = cut_lineage(spark.range(5), "gone")
        files = gone.inputFiles()
        with scratch(spark) as inner:
            kept = inner(cut_lineage(gone.selectExpr("id * 2 AS id"), "kept"))
        keep_table(kept)
        assert os.path.exists(files[0].removeprefix("file://"))
    assert not os.path.exists(files[0].removeprefix("file://")) and kept.count() == 5
