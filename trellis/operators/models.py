"""Model fitting, tuning and cross-validation on Spark ML.

Mapping of the reference's learners:

* logistic regression, L2, C=1, max_iter=2000 -> ``LogisticRegression`` with
  ``regParam = 1 / sum(weights)`` (Spark averages the loss, sklearn sums it)
  and no internal standardisation;
* random forest -> ``RandomForestClassifier`` with ``sqrt`` feature subsets;
  "unlimited" depth is Spark's maximum (30); ``min_samples_split = s`` is
  approximated by ``minInstancesPerNode = ceil(s / 2)``;
* boosted trees -> ``GBTClassifier`` (first-order leaves; results are close
  to, not equal to, second-order boosting) or, with ``booster="newton"``,
  ``boosting.NewtonBoosting``; ``scale_pos_weight`` becomes a row weight on
  the positives;
* random-forest regressor with all features per split.

Trees of large tables learn from cells, see ``cells``.

Folds are a column (``foldCol``), produced by the exact split operators, so
every fit sees the same, reproducible folds; tuning runs fold x parameter fits
in parallel (``parallelism``) and every fit is itself distributed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trellis.operators.cells import CellForestClassifier, CellForestRegressor, CellGBTClassifier, FoldCells, SubsetCells, takes_cells
from trellis.operators.metrics import binary_metrics, confusion_counts

# Fixed values of the reference workflow.
SEED = 42
LR_MAX_ITER = 2000
MAX_TREE_DEPTH = 30            # stands for "no depth limit"
RF_GRID_RED = {"numTrees": [100, 200], "maxDepth": [10, 20, MAX_TREE_DEPTH], "min_samples_split": [5, 10]}
RF_GRID_WHITE = {"numTrees": [100, 200], "maxDepth": [10, 20], "min_samples_split": [5, 10]}
GBT_GRID = {"maxIter": [100, 200], "maxDepth": [4, 6], "stepSize": [0.05, 0.1]}
GBT_FIXED = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1}
RF_REGRESSOR_TREES = 100

#: MB of split statistics a task may hold: enough for one pass a level in forests of this size
FOREST_MB = 512
#: deep forests remember every row's node beside the rows (written out every 10 levels), so that a
#: level's tasks carry the frontier and not all trees grown so far
DEEP_TREES = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": FOREST_MB}


# --------------------------------------------------------------------------- evaluation

class PositiveF1Evaluator(Evaluator):
    """F1 of the positive class with zero_division=0 (sklearn ``scoring='f1'``).

    Spark's ``f1`` metric is the weighted F1 and ``fMeasureByLabel`` throws
    when a fold has neither positive labels nor positive predictions; this
    evaluator is one aggregate of confusion counts instead.
    """

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        return self.from_counts(confusion_counts(dataset, self.getOrDefault(self.labelCol), self.getOrDefault(self.predictionCol)).first())

    @staticmethod
    def from_counts(c) -> float:
        den = 2 * c["tp"] + c["fp"] + c["fn"]
        return 0.0 if den == 0 else 2.0 * c["tp"] / den

    def isLargerBetter(self) -> bool:
        return True


def weighted_counts(scored: DataFrame, n: str, label: str):
    """``tp, fp, fn, tn`` of rows that stand for ``n`` rows each."""
    y, p = F.col(label), F.col("prediction")
    total = lambda a, b: F.coalesce(F.sum(F.when((y == a) & (p == b), F.col(n))), F.lit(0))
    return scored.agg(total(1, 1).alias("tp"), total(0, 1).alias("fp"), total(1, 0).alias("fn"), total(0, 0).alias("tn")).first()


def probability_column(scored: DataFrame, prob_col: str = "probability", out: str = "p1",
                       positive_index: int = 1) -> DataFrame:
    """Positive-class probability as a double column."""
    return scored.withColumn(out, vector_to_array(F.col(prob_col))[positive_index])


# --------------------------------------------------------------------------- estimators

def assembler(features: Sequence[str], out: str = "features", handle_invalid: str = "error"
              ) -> VectorAssembler:
    """Feature vector in the given column order."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid=handle_invalid)


def logistic_regression(n_weight: float, label: str = "label", weight_col: str | None = None,
                        features: str = "features", C: float = 1.0) -> LogisticRegression:
    """L2 logistic regression equivalent to sklearn's C-parameterised objective."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=LR_MAX_ITER,
                            regParam=1.0 / (C * max(n_weight, 1.0)), elasticNetParam=0.0,
                            standardization=False, tol=1e-8)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def random_forest(num_trees: int = 100, max_depth: int | None = None, min_samples_split: int = 2,
                  label: str = "label", weight_col: str | None = None, features: str = "features",
                  seed: int = SEED, max_bins: int = 32) -> RandomForestClassifier:
    depth = MAX_TREE_DEPTH if max_depth is None else min(max_depth, MAX_TREE_DEPTH)
    rf = CellForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees,
                                maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed,
                                minInstancesPerNode=max(1, math.ceil(min_samples_split / 2)),
                                maxBins=max_bins, **DEEP_TREES)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def boosted_trees(max_iter: int = 200, max_depth: int = 6, step_size: float = 0.1,
                  label: str = "label", weight_col: str | None = None, features: str = "features",
                  seed: int = SEED, max_bins: int = 32, booster: str = "gbt"):
    """Boosted trees: Spark's first-order form, or the second-order one (``booster="newton"``, 256 bins)."""
    if booster == "newton":
        from trellis.operators.boosting import NewtonBoosting
        return NewtonBoosting(featuresCol=features, labelCol=label, weightCol=weight_col, maxIter=max_iter,
                              maxDepth=max_depth, stepSize=step_size)
    if booster != "gbt":
        raise ValueError(f"unknown booster {booster!r}")
    gbt = CellGBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step_size, seed=seed, maxBins=max_bins)
    if weight_col:
        gbt.setWeightCol(weight_col)
    return gbt


def rf_regressor(num_trees: int = RF_REGRESSOR_TREES, label: str = "label", features: str = "features",
                 max_depth: int | None = None, seed: int = SEED, max_bins: int = 32) -> RandomForestRegressor:
    depth = MAX_TREE_DEPTH if max_depth is None else min(max_depth, MAX_TREE_DEPTH)
    return CellForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees,
                                 maxDepth=depth, featureSubsetStrategy="all", seed=seed, maxBins=max_bins, **DEEP_TREES)


def with_positive_weight(df: DataFrame, label: str, pos_weight: float, out: str = "weight") -> DataFrame:
    """Row weight ``pos_weight`` on positives, 1 on negatives (``scale_pos_weight``)."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


# --------------------------------------------------------------------------- scoring

def score(model, df: DataFrame, label: str = "label", key: Sequence[str] = ()) -> DataFrame:
    """Scored table ``(key..., label, prediction int, p1 double)`` (P12). Models
    without probabilities get a NULL ``p1``."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = probability_column(out)
    else:
        out = out.withColumn("p1", F.lit(None).cast("double"))
    return out.select(*key, F.col(label), F.col("prediction").cast("int").alias("prediction"), "p1")


def evaluate(model, test: DataFrame, name: str, label: str = "label") -> DataFrame:
    """Metric row of a fitted model on untouched test rows."""
    return evaluate_scored(model, test, name, label)[0]


def evaluate_scored(model, test: DataFrame, name: str, label: str = "label",
                    key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Metric row plus the scored test rows ``(key..., label, prediction,
    p1)``. The scored rows are written once: the confusion counts, the AUC
    table and any later report read them, so inference runs a single time."""
    from trellis.session import cut_lineage
    sc = cut_lineage(score(model, test, label, key), "scored")
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    has_prob = "probabilityCol" in [p.name for p in stage.params]
    return binary_metrics(sc, label, "prediction", "p1" if has_prob else None, name), sc


# --------------------------------------------------------------------------- tuning

def param_grid(estimator, grid: dict) -> list[dict]:
    """Expand a {param: values} grid; ``min_samples_split`` maps to
    ``minInstancesPerNode``."""
    keys = list(grid)
    maps = []
    for values in product(*[grid[k] for k in keys]):
        pm = {}
        for k, v in zip(keys, values):
            if k == "min_samples_split":
                pm[estimator.getParam("minInstancesPerNode")] = max(1, math.ceil(v / 2))
            elif k == "maxDepth":
                pm[estimator.getParam("maxDepth")] = min(v, MAX_TREE_DEPTH)
            else:
                pm[estimator.getParam(k)] = v
        maps.append(pm)
    return maps


def grid_search(pipeline_stages: Sequence, estimator, grid: dict, train: DataFrame, fold_col: str,
                k: int, label: str = "label", parallelism: int = 4):
    """Grid search with positive-class F1 over the fold column, refit on all
    training rows (M6). Returns (best PipelineModel, table of mean F1 per
    parameter set)."""
    pipe = Pipeline(stages=[*pipeline_stages, estimator])
    maps = param_grid(estimator, grid)
    cells = _grid_cells(pipeline_stages, estimator, maps, train, fold_col, k, label)
    if cells is None:
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps,
                            evaluator=PositiveF1Evaluator(label, "prediction"),
                            foldCol=fold_col, numFolds=k, parallelism=parallelism, seed=SEED,
                            collectSubModels=False)
        fitted = cv.fit(train)
        best, means = fitted.bestModel, fitted.avgMetrics
    else:
        ev = PositiveF1Evaluator(label, "prediction")

        def one(task):
            f, params = task
            est = estimator.copy(params)
            m = cells.fit(f, est)
            if m is not None:
                return ev.from_counts(weighted_counts(m.transform(cells.held(f)), "n", label))
            m = Pipeline(stages=[*pipeline_stages, est]).fit(train.where(F.col(fold_col) != f))
            return ev.evaluate(m.transform(train.where(F.col(fold_col) == f)))
        scores = run_parallel(one, product(range(k), maps), parallelism)
        means = [sum(scores[i::len(maps)]) / k for i in range(len(maps))]
        best = pipe.fit(train, maps[max(range(len(maps)), key=lambda i: (means[i], -i))])
    rows = [(", ".join(f"{p.name}={v}" for p, v in m.items()), float(s)) for m, s in zip(maps, means)]
    schema = StructType([StructField("params", StringType()), StructField("mean_f1", DoubleType())])
    table = train.sparkSession.createDataFrame(rows, schema)
    return best, table


def _grid_cells(stages: Sequence, estimator, maps: list[dict], train: DataFrame, fold_col: str, k: int, label: str) -> FoldCells | None:
    """The folds' cells, shared by all parameter sets: ``CrossValidator`` would keep every fold's training and held-out rows on
    disk and read them for each set. None where rows are needed."""
    same = {"maxBins", "featuresCol", "labelCol", "weightCol"}
    if not all(isinstance(s, Transformer) for s in stages) or estimator.getLabelCol() != label \
            or estimator.getPredictionCol() != "prediction" or any(p.name in same for m in maps for p in m) \
            or not all(takes_cells(estimator.copy(m)) for m in maps):
        return None
    folds = [r[0] for r in train.select(fold_col).distinct().limit(k + 1).collect()]
    if len(folds) < 2 or any(f is None or not 0 <= f < k or f != int(f) for f in folds):
        return None     # CrossValidator says what is wrong with them
    return FoldCells.of(estimator, PipelineModel(stages=list(stages)).transform(train), fold_col, k)


def grid_search_prepared(options: dict, learner, grid: dict, folded: DataFrame, fold_col: str, k: int,
                         label: str = "label", parallelism: int = 2):
    """Grid search where every fold prepares its own training part. ``options`` names the
    preparations to try (a ``preparation.Preparation`` each); ``learner`` is an estimator or a function
    from prepared rows to one. A fold's part is prepared and written once for all parameter sets;
    validation rows are the fold's real rows, prepared with the training part's statistics. Returns
    (pipeline of the best option refitted on all rows, table of mean F1, its preparation, its learner)."""
    from trellis.operators.preparation import fit_learner
    from trellis.session import cut_lineage
    fitted = {(name, f): one for name, prep in options.items()
              for f, one in prep.fit_folds(folded, fold_col, range(k)).items()}

    def prepared(task):
        held = PipelineModel(stages=fitted[task].stages).transform(folded.where(F.col(fold_col) == task[1]))
        return (fitted[task].assembled(folded.where(F.col(fold_col) != task[1])), cut_lineage(held.select(label, "features"), "held"))
    parts = dict(zip(fitted, run_parallel(prepared, fitted, parallelism)))
    ev = PositiveF1Evaluator(label, "prediction")

    def with_params(params):
        def make(rows):
            est = learner if isinstance(learner, Estimator) else learner(rows)
            return est.copy(param_grid(est, {n: [v] for n, v in params.items()})[0])
        return make

    def one(task):
        name, params, f = task
        rows, held = parts[(name, f)]
        return ev.evaluate(fit_learner(with_params(params), rows).transform(held))
    keys = list(grid)
    sets = [(name, dict(zip(keys, values))) for name in options for values in product(*[grid[x] for x in keys])]
    scores = run_parallel(one, [(name, params, f) for name, params in sets for f in range(k)], parallelism)
    means = [sum(scores[i * k:(i + 1) * k]) / k for i in range(len(sets))]
    name, params = sets[max(range(len(sets)), key=lambda i: (means[i], -i))]
    rows = [(", ".join([n] * (len(options) > 1) + [f"{x}={v}" for x, v in p.items()]), m) for (n, p), m in zip(sets, means)]
    table = folded.sparkSession.createDataFrame(rows, "params string, mean_f1 double")
    best = with_params(params)
    return options[name].model(best)(folded), table, options[name], best


def run_parallel(fn, items, parallelism: int):
    """Run independent fits as concurrent Spark jobs (as ``CrossValidator``
    does with ``parallelism``); results keep the input order."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if parallelism <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        futures = [pool.submit(fn, x) for x in items]
    return [f.result() for f in futures]


def fitter(model):
    """``fit(train part) -> model``: an estimator's ``fit``, or the function itself, which
    may impute, weight or oversample the part it gets -- and nothing else."""
    return model.fit if isinstance(model, Estimator) else model


def cv_fold_scores(pipeline, df: DataFrame, fold_col: str, k: int, name: str,
                   label: str = "label", parallelism: int = 4, keep_scored: bool = False,
                   key: Sequence[str] = ()):
    """Positive-class F1 of ``pipeline`` on every held-out fold: long
    ``(model, fold, score)`` (M7). The same fold column for every model keeps
    the paired test valid. ``pipeline`` is an estimator or a function from a
    training part to a fitted model (see ``fitter``). With ``keep_scored`` also
    the out-of-fold scored rows ``(key..., label, prediction, p1)`` -- the
    leak-free input for choosing a decision threshold."""
    ev = PositiveF1Evaluator(label, "prediction")
    models_out = {}

    def one(f):
        m = fitter(pipeline)(df.where(F.col(fold_col) != f))
        models_out[f] = m
        return (name, f, ev.evaluate(m.transform(df.where(F.col(fold_col) == f))))
    rows = run_parallel(one, range(k), parallelism)
    scores = df.sparkSession.createDataFrame(rows, "model string, fold int, score double")
    if not keep_scored:
        return scores
    # out-of-fold predictions: every row scored by the model that did not see it
    oof = None
    for f in range(k):
        part = score(models_out[f], df.where(F.col(fold_col) == f), label, key)
        oof = part if oof is None else oof.unionByName(part)
    return scores, oof


def _fold_cells(pipeline, df: DataFrame, fold_col: str, k: int, label: str) -> FoldCells | None:
    stages = pipeline.getStages() if isinstance(pipeline, Pipeline) else [pipeline]
    if not stages or not all(isinstance(s, Transformer) for s in stages[:-1]):
        return None     # a stage is fitted in every fold
    if not isinstance(stages[-1], CellForestRegressor) or stages[-1].getLabelCol() != label:
        return None
    return FoldCells.of(stages[-1], PipelineModel(stages=stages[:-1]).transform(df), fold_col, k)


def cv_regression_scores(pipeline, df: DataFrame, fold_col: str, k: int, name: str,
                         label: str = "label", parallelism: int = 4) -> DataFrame:
    """RMSE per held-out fold for a regressor. Where the learner reads cells and the stages before it are
    fitted already, all folds are summed to cells together: the passes over the rows do not grow with ``k``."""
    cells = _fold_cells(pipeline, df, fold_col, k, label)

    def one(f):
        error = F.pow(F.col(label) - F.col("prediction"), 2)
        m = cells.fit(f) if cells else None
        if m is not None:
            pred, mean = m.transform(cells.held(f)), F.try_divide(F.sum(error * F.col("n")), F.sum("n"))
        else:
            m = fitter(pipeline)(df.where(F.col(fold_col) != f))
            pred, mean = m.transform(df.where(F.col(fold_col) == f)), F.avg(error)
        mse = pred.agg(mean).first()[0]
        return (name, f, math.sqrt(mse) if mse is not None else None)
    rows = run_parallel(one, range(k), parallelism)
    return df.sparkSession.createDataFrame(rows, "model string, fold int, score double")


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Normalised impurity importances, sorted descending (M8)."""
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    imp = m.featureImportances.toArray()
    total = float(imp.sum()) or 1.0
    rows = [(f, float(v) / total) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.col("importance").desc(), F.col("feature"))


def learning_curve(pipeline, folded: DataFrame, key: str, k: int, label: str = "label",
                   fold_col: str = "fold", parallelism: int = 4) -> DataFrame:
    """Training and CV F1 per training-subset size (M9): for every fold and size, fit on the first
    ``size`` training rows (hash order) and score both the subset and the held-out fold. ``pipeline`` is
    an estimator or a function from a training part to a fitted model (see ``fitter``), so a subset is
    prepared on its own rows. Subsets come from ``split.learning_cuts``. Where a prepared learner reads cells, large subsets
    are prepared, summed and scored together: the passes over the rows grow with the folds, not with the fits."""
    from trellis.operators.split import learning_cuts, learning_subset
    ev = PositiveF1Evaluator(label, "prediction")
    cuts = learning_cuts(folded, key, k, fold_col)
    cells, weights = _subset_cells(pipeline, folded, key, label, fold_col, cuts, parallelism)

    def one(task):
        (f, j), (size, last) = task
        found = cells.fit((f, j), size, weights) if cells and (f, j) in cells.last else None
        if found:
            m, own, held = found
            return (j, size, f, *[ev.from_counts(weighted_counts(m.transform(rows), "n", label)) for rows in (own, held)])
        held = folded.where(F.col(fold_col) == f)
        sub = learning_subset(folded, key, f, last, fold_col)
        m = fitter(pipeline)(sub)
        return (j, size, f, ev.evaluate(m.transform(sub)), ev.evaluate(m.transform(held)))
    rows = run_parallel(one, cuts.items(), parallelism)
    per = folded.sparkSession.createDataFrame(
        rows, "size_idx int, train_size long, fold int, train_f1 double, cv_f1 double")
    return per.groupBy("size_idx").agg(F.avg("train_size").alias("mean_train_size"),
                                       F.avg("train_f1").alias("train_f1"),
                                       F.avg("cv_f1").alias("cv_f1")).orderBy("size_idx")


def _subset_cells(pipeline, folded: DataFrame, key: str, label: str, fold_col: str, cuts: dict, parallelism: int):
    """The cells of the subsets with more than ``ROWS`` rows and their label weights, or None where rows are needed."""
    from trellis.functions.columns import hash_order
    from trellis.operators.cells import ROWS
    from trellis.operators.preparation import WEIGHT, PreparedLearner
    from trellis.operators.split import SEED as SPLIT_SEED
    from trellis.session import cut_lineage
    large = {t: c for t, c in cuts.items() if c[0] > ROWS}
    if not large or not isinstance(pipeline, PreparedLearner):
        return None, None
    prep, est = pipeline.preparation, pipeline.learner
    if not takes_cells(est) or prep.scale or prep.resample or prep.label != label or est.getLabelCol() != label \
            or est.getPredictionCol() != "prediction" or (est.getWeightCol() if est.isDefined(est.weightCol) else None) != (WEIGHT if prep.weight else None):
        return None, None
    feats = list(prep.features)
    hashes = sorted({last for _, last in large.values()})

    def level(a: int, b: int):
        """Number of hashes below the row's, by halving."""
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(F.col("_h") <= hashes[mid], level(a, mid)).otherwise(level(mid + 1, b))
    narrow = folded.select(hash_order(key, SPLIT_SEED).alias("_h"), F.col(fold_col).alias("fold"), F.col(label).cast("double").alias("y"),
                           *[F.col(f"`{c}`").cast("double").alias(c) for c in feats])
    rows = cut_lineage(narrow.select("fold", level(0, len(hashes)).alias("level"), "y", *[F.col(f"`{c}`") for c in feats]), "subsets")
    odd = rows.where(F.col("y").isNull() | F.isnan("y") | ~F.col("y").isin(0.0, 1.0) | F.greatest(*[F.isnan(F.col(f"`{c}`")) for c in feats], F.lit(False)))
    if odd.limit(1).count():
        return None, None     # the learner says what is wrong with them
    last = {t: hashes.index(h) for t, (_, h) in large.items()}
    fitted = prep.fit_parts(rows, {t: ~F.col("fold").eqNullSafe(F.lit(t[0])) & (F.col("level") <= n) for t, n in last.items()}) \
        if prep.impute else {}
    fill = {t: [fitted[t].steps[0].medians[c] for c in feats] if fitted else [None] * len(feats) for t in last}
    if any(v is None for values in fill.values() for v in values):
        return None, None
    cells = SubsetCells(est, rows.select("fold", "level", "y", F.array(*[F.col(f"`{c}`") for c in feats]).alias("x")), len(feats), last, fill)
    run_parallel(cells.sum_fold, sorted({f for f, _ in last}), parallelism)

    def weights(counts: dict) -> dict:
        if prep.weight == "balanced":
            return {y: sum(counts.values()) / (len(counts) * n) for y, n in counts.items()}
        ratio = counts.get(0.0, 0) / counts[1.0] if prep.weight and counts.get(1.0) else 1.0
        return {y: (ratio or 1.0) if y == 1.0 else 1.0 for y in counts}
    return cells, weights


def compare(fitted: dict, test: DataFrame, label: str = "label") -> DataFrame:
    """Metric table of several fitted models on the same test rows."""
    from trellis.operators.metrics import compare_models
    return compare_models([evaluate(m, test, name, label) for name, m in fitted.items()])

