"""Threshold curves and calibration.

Scores are first collapsed to distinct values with positive/negative counts
(``groupBy(score)``, map-side combined, so a score held by a third of the rows
is one row). Running counts over the distinct scores come from one range
exchange: every range sums its own rows, the ranges' totals give the offsets,
so no window ever holds the whole table in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.columns import safe_div
from trellis.operators.metrics import confusion_counts, metrics_from_counts
from trellis.operators.prep import threshold_predict
from trellis.session import cut_lineage

# Fixed values of the reference workflow.
CALIBRATION_BINS = 10
FALLBACK_THRESHOLD = 0.5


def _run(batches):
    """Running counts of the sorted rows of one task, and the counts of the row after each (-1 after
    the last)."""
    pos = neg = 0
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.assign(cpos=pos + pdf["pos"].cumsum(), cneg=neg + pdf["neg"].cumsum())
        pos, neg = int(pdf["cpos"].iloc[-1]), int(pdf["cneg"].iloc[-1])
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        after = {f"next_{c}": rows[c].shift(-1).fillna(-1).astype("int64") for c in ("pos", "neg")}
        rows, held = rows.assign(**after).iloc[:-1], rows.iloc[-1:]
        yield rows
    if held is not None:
        yield held.assign(next_pos=-1, next_neg=-1)


def score_counts(scored: DataFrame, label: str, score: str, parts: int | None = None
                 ) -> tuple[DataFrame, int, int]:
    """Distinct scores with ``pos``/``neg`` counts, the descending running counts ``tps``/``fps``
    (sklearn's binary curve) and the counts of the next lower score (``next_pos``/``next_neg``, NULL after
    the last), plus the class totals P and N.

    The raw table is read once. Its distinct scores go through one range exchange, whatever their
    spread; every range sums up its own sorted rows and is written. The ranges' totals (one row each)
    then give the offsets. So the written table is read twice: for the totals and for the curve.
    ``parts`` fixes the number of ranges (default: by their size).
    """
    s = F.col(score).cast("double")
    base = scored.select(s.alias("score"), F.col(label).alias("_y")).where(F.col("score").isNotNull())
    dist = base.groupBy("score").agg(F.count(F.when(F.col("_y") == 1, 1)).alias("pos"),
                                     F.count(F.when(F.col("_y") == 0, 1)).alias("neg"))
    order = F.col("score").desc()
    ranged = dist.repartitionByRange(parts, order) if parts else dist.repartitionByRange(order)
    schema = "score double, pos long, neg long, part int, cpos long, cneg long, next_pos long, next_neg long"
    runs = cut_lineage(ranged.sortWithinPartitions(order).select("*", F.spark_partition_id().alias("part"))
                       .mapInPandas(_run, schema), "curve")
    totals = runs.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"),
                                      F.max_by(F.struct("pos", "neg"), "score").alias("first")).orderBy("part").collect()
    offsets, P, N = [], 0, 0
    for i, r in enumerate(totals):
        nxt = totals[i + 1]["first"] if i + 1 < len(totals) else (None, None)
        offsets.append((r["part"], P, N, nxt[0], nxt[1]))
        P, N = P + int(r["p"]), N + int(r["n"])
    table = scored.sparkSession.createDataFrame(offsets, "part int, p0 long, n0 long, p1 long, n1 long")
    cum = runs.join(table, "part").select(
        "score", "pos", "neg", (F.col("cpos") + F.col("p0")).alias("tps"), (F.col("cneg") + F.col("n0")).alias("fps"),
        *[F.when(F.col(f"next_{c}") >= 0, F.col(f"next_{c}")).otherwise(F.col(o)).alias(f"next_{c}")
          for c, o in (("pos", "p1"), ("neg", "n1"))])
    return cum, P, N


def roc_auc_value(scored: DataFrame, label: str, score: str, counts=None) -> float | None:
    """Exact ROC-AUC (trapezoid = Mann-Whitney with mid-ranks for ties).

    ``AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P*N)``; integer sums in
    decimal(38) so nothing overflows. ``None`` when a class is missing.
    """
    cum, P, N = counts or score_counts(scored, label, score)
    if P == 0 or N == 0:
        return None
    dec = "decimal(38,0)"
    # neg strictly below s = N - fps(s)
    term = F.col("pos").cast(dec) * (F.lit(2 * N).cast(dec) - F.lit(2).cast(dec) * F.col("fps").cast(dec)
                                     + F.col("neg").cast(dec))
    num = cum.agg(F.sum(term).alias("num")).first()["num"]
    return float(num) / float(2 * P * N)


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One-row ``roc_auc`` table."""
    v = roc_auc_value(scored, label, score)
    return scored.sparkSession.createDataFrame([(v,)], "roc_auc double")


def roc_curve(scored: DataFrame, label: str, score: str, drop_intermediate: bool = True
              ) -> DataFrame:
    """ROC points ``(threshold, fpr, tpr)`` by descending threshold.

    As sklearn: a point is dropped when the next step repeats its step
    exactly (same positive and negative increments); the first and last
    points stay; the origin is added with a NULL threshold (above every
    score).
    """
    cum, P, N = score_counts(scored, label, score)
    pts = cum
    if drop_intermediate:
        first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
        last = F.col("next_pos").isNull()
        changes = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        pts = pts.where(first | last | changes)
    curve = pts.select(F.col("score").alias("threshold"),
                       safe_div(F.col("fps"), F.lit(N), zero=None).alias("fpr"),
                       safe_div(F.col("tps"), F.lit(P), zero=None).alias("tpr"))
    origin = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(curve)


def pr_curve(scored: DataFrame, label: str, score: str, counts=None) -> DataFrame:
    """Precision, recall and F1 at every distinct threshold (predict ``>= t``),
    ascending (A16). F1 of 0/0 is 0; recall is 1 when there is no positive."""
    cum, P, _ = counts or score_counts(scored, label, score)
    precision = safe_div(F.col("tps"), F.col("tps") + F.col("fps"))
    recall = F.lit(1.0) if P == 0 else safe_div(F.col("tps"), F.lit(P))
    out = cum.select(F.col("score").alias("threshold"), precision.alias("precision"),
                     recall.alias("recall"))
    return out.withColumn("f1", safe_div(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall")))


def best_threshold(scored: DataFrame, label: str, score: str, counts=None) -> DataFrame:
    """F1-optimal threshold; ties go to the lowest threshold (A16). A top-1
    over the curve: each task keeps one candidate."""
    return pr_curve(scored, label, score, counts).orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)


def best_threshold_value(scored: DataFrame, label: str, score: str, counts=None) -> float:
    row = best_threshold(scored, label, score, counts).first()
    return float(row["threshold"]) if row is not None else FALLBACK_THRESHOLD


def tuned_metrics(scored: DataFrame, label: str, score: str, threshold: float,
                  model: str | None = None, auc: float | None = None) -> DataFrame:
    """All five metrics re-computed at a tuned threshold (A17); the
    reference kept stale precision/recall here."""
    pred = scored.withColumn("_tuned", threshold_predict(score, threshold))
    if auc is None:
        auc = roc_auc_value(scored, label, score)
    return metrics_from_counts(confusion_counts(pred, label, "_tuned"), model, auc) \
        .withColumn("threshold", F.lit(float(threshold)))


def calibration_edges(n_bins: int = CALIBRATION_BINS) -> list[float]:
    import numpy as np
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def calibration_bins(scored: DataFrame, label: str, score: str, n_bins: int = CALIBRATION_BINS
                     ) -> DataFrame:
    """Reliability table ``(bin, n, mean_predicted, fraction_positive)`` with
    uniform, right-closed bins ``(e_{i-1}, e_i]`` (the first includes 0); empty
    bins are dropped (A18). The bin id counts inner edges strictly below the
    score, so values on an edge match the reference exactly."""
    edges = calibration_edges(n_bins)[1:-1]
    s = F.col(score).cast("double")
    bin_id = sum((F.when(s > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    return scored.where(s.isNotNull()).groupBy(bin_id.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("fraction_positive"))


def calibration_summary(scored: DataFrame, label: str, score: str,
                        n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """Expected calibration error and Brier score (one row)."""
    bins = calibration_bins(scored, label, score, n_bins)
    ece = bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("fraction_positive")))
                    / F.sum("n")).alias("ece"))
    brier = scored.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier")).first()["brier"]
    return ece.withColumn("brier", F.lit(brier))
