"""End-to-end workflows: the reference's scripts as configurable, leak-safe
Spark jobs.

Order of every classification run (the reference's contract): dedup at load
-> exact stratified split -> clean the training part only (IQR) -> fit
preprocessing on train, apply to test -> fit models -> evaluate on the
untouched test rows. The prepared table is checkpointed into the shared
checkpoint folder after the split, so model fits and fold loops re-read it
instead of recomputing the lineage, and a lost executor only costs a re-read.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import metrics, models, prep, profile, split
from trellis.operators.preparation import WEIGHT, Preparation, fit_learner
from trellis.operators.transform import fit_standard_scaler
from trellis.session import cut_lineage, forget


@dataclass
class ModelSizes:
    """Learner sizes. ``small()`` is for smoke runs. ``rf_depth`` None is the
    largest depth Spark grows (30), which stands for "no limit"."""
    rf_trees: int = 100
    rf_depth: int | None = None
    rf_min_split: int = 5
    gbt_iter: int = 200
    gbt_depth: int = 6
    gbt_step: float = 0.1
    booster: str = "gbt"          # or "newton", the second-order form

    @staticmethod
    def small() -> "ModelSizes":
        return ModelSizes(rf_trees=20, rf_depth=8, rf_min_split=5, gbt_iter=20, gbt_depth=4, gbt_step=0.1)


@dataclass
class ClassificationResult:
    prepared: DataFrame
    split_check: DataFrame
    comparison: DataFrame
    fitted: dict = field(default_factory=dict)
    scored: dict = field(default_factory=dict)   # model title -> written scored test rows
    train: DataFrame | None = None               # cleaned training rows, not yet imputed or resampled
    recipes: dict = field(default_factory=dict)  # model title -> (Preparation, learner), as fitted
    grids: dict = field(default_factory=dict)    # model title -> mean F1 per parameter set


def prepare(df: DataFrame, key: str, label: str, features: Sequence[str], test_fraction: float = 0.2,
            seed: int = 42, checkpoint: bool = True) -> DataFrame:
    """Split exactly and keep only what the models need; cut the lineage.

    The input is written once first: the split reads it several times (class counts,
    hash ranges) and must not recompute upstream shuffles such as the dedup
    for each read. It goes when the split is written."""
    base = df.select(key, label, *features)
    if not checkpoint:
        return split.stratified_split(base, key, label, test_fraction, seed)
    base = cut_lineage(base, "input")
    sp = cut_lineage(split.stratified_split(base, key, label, test_fraction, seed), "split")
    forget(base)
    return sp


LEARNERS = ("baseline", "lr", "rf", "gbt")
BASELINE, LR, RF, GBT = "Baseline", "Logistic Regression", "Random Forest", "Gradient Boosted Trees"


def recipe(name: str, key: str, label: str, features: Sequence[str], sizes: ModelSizes, balanced: bool = True,
           resample: str | None = None, scale_forest: bool = False) -> tuple[str, Preparation, object]:
    """Title, preparation and learner of a model. Imputation, scaling, SMOTE and weights are part of
    the preparation, so every fit learns them from its own training part. With SMOTE the linear model
    and the forest see scaled rows (neighbours are searched there); boosted trees are never resampled,
    they weight the positives by neg / pos."""
    weight = "balanced" if balanced and not resample else None
    if name == "lr":
        prep = Preparation(key, label, features, scale=True, resample=resample, weight=weight)

        def learner(rows: DataFrame):   # the penalty is set against the sum of the weights
            total = rows.agg(F.sum(WEIGHT) if weight else F.count(F.lit(1))).first()[0]
            return models.logistic_regression(float(total or 1.0), label, WEIGHT if weight else None)
        return LR, prep, learner
    if name == "rf":
        return RF, Preparation(key, label, features, scale=scale_forest or bool(resample), resample=resample, weight=weight), \
            models.random_forest(sizes.rf_trees, sizes.rf_depth, sizes.rf_min_split, label, WEIGHT if weight else None)
    if name == "gbt":
        prep = Preparation(key, label, features, weight="positive" if balanced or resample else None)
        return GBT, prep, models.boosted_trees(sizes.gbt_iter, sizes.gbt_depth, sizes.gbt_step, label,
                                               WEIGHT if prep.weight else None, booster=sizes.booster)
    raise ValueError(f"unknown learner {name!r}")


def classification(df: DataFrame, key: str, label: str, features: Sequence[str],
                   sizes: ModelSizes | None = None, iqr: bool = True, balanced: bool = True,
                   learners: Sequence[str] = LEARNERS,
                   checkpoint: bool = True, parallelism: int = 3, tune: bool = False,
                   rf_grid: dict | None = None, gbt_grid: dict | None = None,
                   rf_folds: int = 5, gbt_folds: int = 3, resample: str | None = None,
                   iqr_columns: Sequence[str] | None = None, scale_forest: bool = False) -> ClassificationResult:
    """Entry A of the reference as one function: split, verify, clean the training part, fit
    baseline / logistic regression / random forest / boosted trees and compare them on the test rows.

    NULL features are imputed by the training part's medians. ``resample='smote'`` oversamples the
    minority class instead of weighting, inside every fit (see ``recipe``). The IQR rule cleans
    ``iqr_columns`` (all features).

    With ``tune`` the forest and the boosted trees are grid-searched on the training rows
    (positive-class F1 over exact stratified folds, every fold prepared on its own training part,
    refit on all training rows): the forest over ``rf_grid`` (default: the reference's grid), the
    boosted trees over ``gbt_grid`` crossed with a positive-class weight of 1 or neg/pos."""
    sizes = sizes or ModelSizes()
    prepared = prepare(df, key, label, features, checkpoint=checkpoint)
    check = profile.split_verification(prepared, label)
    train = prepared.where(F.col("split") == "train")
    test = prepared.where(F.col("split") == "test")
    cleaned = list(features) if iqr_columns is None else list(iqr_columns)
    if iqr and cleaned:
        train = profile.iqr_filter(train, cleaned)
    if checkpoint:  # every learner prepares the cleaned training rows
        train = cut_lineage(train, "train")

    def tuned(name, prep, learner):
        folded = split.stratified_kfold(train, key, label, k=rf_folds if name == "rf" else gbt_folds)
        folded = cut_lineage(folded, f"{name}-folds") if checkpoint else folded
        if name == "rf":
            return models.grid_search_prepared({"": prep}, learner, dict(rf_grid or models.RF_GRID_RED), folded, "fold",
                                               rf_folds, label)
        options = {"weight=1": replace(prep, weight=None), "weight=neg/pos": replace(prep, weight="positive")}
        unweighted = recipe(name, key, label, features, sizes, balanced=False)[2]

        def learner_of(rows: DataFrame):
            return unweighted.copy().setWeightCol(WEIGHT) if WEIGHT in rows.columns else unweighted
        return models.grid_search_prepared(options, learner_of, dict(gbt_grid or models.GBT_GRID), folded, "fold",
                                           gbt_folds, label)

    lock, resampled = threading.Lock(), []

    def resampled_part(prep):   # learners with the same preparation search the neighbours once
        with lock:
            for known, fitted, rows in resampled:
                if known == prep:
                    return fitted, rows
            fitted = prep.fit(train)
            rows = fitted.assembled(train)
            resampled.append((prep, fitted, rows))
            return fitted, rows

    def fit(name):
        if name == "baseline":
            return BASELINE, None, metrics.majority_baseline(train, test, label), None, None, None
        title, prep, learner = recipe(name, key, label, features, sizes, balanced, resample, scale_forest)
        grid = None
        if tune and name in ("rf", "gbt"):
            model, grid, prep, learner = tuned(name, prep, learner)
        elif prep.resample and checkpoint:
            fitted, rows = resampled_part(prep)
            model = fitted.pipeline(fit_learner(learner, rows))
        else:
            model = prep.model(learner)(train)
        row, scored = models.evaluate_scored(model, test, title, label, [key])
        return title, model, row, scored, (prep, learner), grid

    # independent learners run as concurrent Spark jobs; rows keep the order
    results = models.run_parallel(fit, list(learners), parallelism)
    of = lambda i: {r[0]: r[i] for r in results if r[i] is not None}
    return ClassificationResult(prepared, check, metrics.compare_models([r[2] for r in results]), of(1), of(3), train, of(4), of(5))


def combined(frames: Sequence[DataFrame], markers: Sequence[int], key: str, label: str,
             features: Sequence[str], marker: str = "type", group_check: bool = True,
             sizes: ModelSizes | None = None, checkpoint: bool = True, report: bool = False,
             cv_folds: int = 10, out_dir: str | None = None, models_too: bool = True, tune: bool = False,
             clean_marker: bool = False) -> dict:
    """Entry B: pool several sources (dedup per source, then a source marker
    column), model with the marker as a feature, and check the feature-label
    relation per source against the pooled one (Simpson's paradox, A28).
    The IQR rule cleans ``features``; with ``clean_marker`` also the marker, which removes
    every row of a source that has under a quarter of the rows. With ``report`` the whole single-source report
    (curves, calibration, CV t-test, learning curve, attributions, bundles)
    runs on the pooled table."""
    pooled = prep.union_sources(frames, marker=marker, markers=markers)
    pooled = prep.row_key(pooled, key) if key not in pooled.columns else pooled
    feats = [*features, marker]
    cleaned = feats if clean_marker else list(features)
    if report:
        out = full_report(pooled, label, feats, key=key, sizes=sizes, cv_folds=cv_folds, out_dir=out_dir, tune=tune,
                          iqr_columns=cleaned, scale_forest=True)
        out["fitted"] = {}
    elif not models_too:  # the relations alone
        out = {}
    else:
        res = classification(pooled, key, label, feats, sizes, learners=("rf", "gbt"), checkpoint=checkpoint, tune=tune,
                             iqr_columns=cleaned, scale_forest=True)
        out = {"comparison": res.comparison, "split_check": res.split_check, "fitted": res.fitted}
    if group_check:
        out["polarity"] = profile.polarity_check(pooled, label, marker, list(features))
        out["correlation"] = profile.corr_matrix(pooled, [*features, marker, label])
    return out


def score_regression(df: DataFrame, key: str, target: str, features: Sequence[str], k: int = 5,
                     trees: int = models.RF_REGRESSOR_TREES, max_depth: int | None = None,
                     checkpoint: bool = True) -> dict:
    """Entry C (score): exact random 80/20 split, scaler fitted on train, forest
    regressor, test metrics (MSE, RMSE, MAE, R^2), k-fold RMSE mean and
    population std, residual histogram and density, importances."""
    base = df.select(key, target, *features)
    base = cut_lineage(base, "input") if checkpoint else base
    sp = split.random_split(base, key)
    if checkpoint:
        sp = cut_lineage(sp, "split")
        forget(base)
    train = sp.where(F.col("split") == "train")
    test = sp.where(F.col("split") == "test")
    scaler = fit_standard_scaler(train, features, suffix="__z")
    scaled = [f + "__z" for f in features]
    pipe = Pipeline(stages=[scaler.as_stage(), models.assembler(scaled),
                            models.rf_regressor(trees, target, max_depth=max_depth)])
    model = pipe.fit(train)
    pred = model.transform(test).select(F.col(target).alias("actual"), F.col("prediction").alias("predicted"))
    pred = cut_lineage(pred, "scored") if checkpoint else pred   # metrics, histogram, KDE, 2-D counts
    resid = pred.select((F.col("actual") - F.col("predicted")).alias("residual"))
    folded = split.kfold(train, key, k)
    folded = cut_lineage(folded, "folds") if checkpoint else folded
    cv = models.cv_regression_scores(pipe, folded, "fold", k, "Random Forest Regressor", target)
    return {"metrics": metrics.regression_metrics(pred), "cv": metrics.cv_summary(cv), "cv_scores": cv,
            "residual_hist": metrics.histogram(resid, "residual"),
            "residual_kde": metrics.gaussian_kde(resid, "residual"),
            "actual_vs_predicted": metrics.joint_counts(pred, "actual", "predicted"),
            "importance": models.feature_importance(model, features, df.sparkSession), "model": model}


def type_prediction(df: DataFrame, key: str, label: str, features: Sequence[str],
                    sizes: ModelSizes | None = None, checkpoint: bool = True, weighted: bool = False) -> dict:
    """Entry C (type): exact stratified split, boosted trees (100 of depth 6, step 0.1, unless
    ``sizes`` says else), accuracy, per-class report, confusion matrix, ROC curve and
    AUC, importances. ``weighted`` weights the positives by ``neg/pos``."""
    from trellis.operators import curves
    sizes = sizes or ModelSizes(gbt_iter=100, gbt_depth=6, gbt_step=0.1)
    prepared = prepare(df, key, label, features, checkpoint=checkpoint)
    train = prepared.where(F.col("split") == "train")
    test = prepared.where(F.col("split") == "test")
    steps = Preparation(key, label, features, weight="positive" if weighted else None)
    model = steps.model(models.boosted_trees(sizes.gbt_iter, sizes.gbt_depth, sizes.gbt_step, label,
                                             WEIGHT if weighted else None))(train)
    scored = models.score(model, test, label, [key])
    scored = cut_lineage(scored, "scored") if checkpoint else scored   # four tables read it
    return {"report": metrics.classification_report(scored, label),
            "confusion": metrics.confusion_matrix(scored, label),
            "roc_curve": curves.roc_curve(scored, label, "p1"),
            "metrics": metrics.binary_metrics(scored, label, "prediction", "p1", "Gradient Boosted Trees"),
            "importance": models.feature_importance(model, features, df.sparkSession), "model": model}


def full_report(raw: DataFrame, label: str, features: Sequence[str], score: str | None = None,
                key: str | None = None, sizes: ModelSizes | None = None, cv_folds: int = 10,
                thresholds: Sequence[int] = (6, 7, 8), tune_on: str = "oof",
                out_dir: str | None = None, learning_folds: int = 5, tune: bool = False,
                resample: str | None = None, rf_grid: dict | None = None, gbt_grid: dict | None = None,
                iqr_columns: Sequence[str] | None = None, scale_forest: bool = False) -> dict:
    """The single-source script end to end, every table as a DataFrame.

    ``raw`` is the loaded, *not yet deduplicated* table (the threshold table is computed on it, as the
    reference does); everything else runs on the deduplicated rows. The profile of the training rows,
    the cross-validations and the learning curve run on the cleaned training rows; every fold and
    subset is imputed, scaled, resampled or weighted on its own, with the recipe of the model that was
    fitted (the tuned one with ``tune``; SMOTE with ``resample='smote'``).

    The forest's decision threshold is chosen on ``tune_on``: 'oof' (default) = out-of-fold predictions
    of the training rows from the cross-validation, 'test' mirrors the reference (which tuned on the
    test rows, an optimistic choice). The comparison ends with the forest at that threshold. With
    ``out_dir`` the model bundles are saved there.
    """
    from trellis.operators import curves, explain
    from trellis.sources.io import save_bundle
    sizes = sizes or ModelSizes()
    spark = raw.sparkSession
    out: dict = {}
    if score is not None and score in raw.columns:
        out["threshold_sensitivity"] = profile.threshold_sensitivity(raw, score, thresholds)
    df = prep.dedup(raw)
    if key is None:
        key = "row_key"
        df = prep.row_key(df, key)
    res = classification(df, key, label, features, sizes, tune=tune, resample=resample, rf_grid=rf_grid, gbt_grid=gbt_grid,
                         iqr_columns=iqr_columns, scale_forest=scale_forest)
    out["split_check"] = res.split_check
    train, test = res.train, res.prepared.where(F.col("split") == "test")
    out["correlation"] = profile.corr_matrix(train, [*features, label])
    out["label_correlation"] = profile.label_correlation(train, label, features)
    out["vif"] = profile.vif(train, features)
    out["class_distribution"] = profile.class_distribution(train, label)
    for title, table in res.grids.items():
        out["grid_" + _slug(title)] = table

    # cross-validation of both tree models on the same folds of the cleaned rows
    folded = cut_lineage(split.stratified_kfold(train, key, label, k=cv_folds), "folds")
    scores, oof = {}, None
    for title in (RF, GBT):
        steps, learner = res.recipes[title]
        found = models.cv_fold_scores(steps.model(learner), folded, "fold", cv_folds, title, label,
                                      keep_scored=title == RF, key=[key])
        scores[title], oof = found if title == RF else (found, oof)
    both = scores[RF].unionByName(scores[GBT])
    out.update(cv_scores=both, cv_summary=metrics.cv_summary(both), cv_box=metrics.box_stats(both),
               t_test=metrics.paired_t_test(both, RF, GBT))

    # the boosted trees explain the test rows; the picked row is explained alone (a top-1)
    gbt = res.fitted[GBT]
    columns = res.recipes[GBT][0].columns
    ready = PipelineModel(stages=gbt.stages[:-1]).transform(test)
    att, base, kind = explain.tree_attributions(ready, [key], columns, gbt.stages[-1])
    out["attributions"] = att
    out["attribution_summary"] = explain.global_importance(att)
    picked = prep.first_positive(res.scored[GBT], key).select(key).first()
    if picked is not None:
        one, _, _ = explain.tree_attributions(ready.where(F.col(key) == F.lit(picked[0])), [key], columns, gbt.stages[-1])
        out["local_explanation"] = explain.local_explanation(one, keys=[key])
    out["attribution_base"] = spark.createDataFrame([(base, kind)], "base double, output string")
    if out_dir:
        save_bundle(spark, gbt, f"{out_dir}/bundle_gbt")
        save_bundle(spark, res.fitted[RF], f"{out_dir}/bundle_rf")
    for title, scored in res.scored.items():   # the rows evaluation already wrote
        out["confusion_" + _slug(title)] = metrics.confusion_matrix(scored, label)
    if learning_folds:
        steps, learner = res.recipes[RF]
        folded = cut_lineage(split.stratified_kfold(train, key, label, k=learning_folds), "learning")
        out["learning_curve"] = models.learning_curve(steps.model(learner), folded, key, learning_folds, label)

    threshold = curves.best_threshold_value(oof if tune_on == "oof" else res.scored[RF], label, "p1")
    tuned_row = curves.tuned_metrics(res.scored[RF], label, "p1", threshold, f"{RF} (tuned threshold)")
    out["tuned_metrics"] = tuned_row
    shared = [c for c in res.comparison.columns if c in tuned_row.columns]
    out["comparison"] = res.comparison.unionByName(tuned_row.select(*shared, F.lit(len(LEARNERS)).alias("ord")))
    for title in (RF, GBT):
        scored, tail = res.scored[title], "" if title == RF else "_gbt"
        out["calibration" + tail] = curves.calibration_bins(scored, label, "p1")
        out["roc_curve" + tail] = curves.roc_curve(scored, label, "p1")
        out["pr_curve" + tail] = curves.pr_curve(scored, label, "p1")
        out["importance_rf" if title == RF else "importance_gbt"] = models.feature_importance(res.fitted[title], features, spark)
    return out


def _slug(title: str) -> str:
    return title.lower().replace(" ", "_")
