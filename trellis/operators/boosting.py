"""Second-order boosted trees for a 0/1 label (M4).

Every round fits one tree to the gradient ``g = w (p - y)`` and curvature ``h = w p (1 - p)`` of the
logistic loss. A node's split maximises

    GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)

over features and cut points, where both sides need a curvature of ``minChildWeight``; a leaf adds
``-stepSize G / (H + lambda)`` to the margin, which starts at 0. ``scale_pos_weight`` is a row weight.

How it runs on Spark: one aggregate gives the cut points (approximate quantiles, all distinct values
where a feature has few), then the rows are packed once into blocks of bytes (one byte a feature,
label, weight and margin) that are dealt to at least as many tasks as there are cores. In tables of over
``ROWS`` rows those that agree in bins, label and weight are first summed to one row (see ``cells``), and
a task holds about one block. A tree level is one
pass over the blocks: each task adds up its blocks' (node, feature, bin) sums of g and h with numpy
and returns one packed array, whose size depends on nodes, features and bins only; with many tasks
the arrays are added in two stages. A task carries the trees since the blocks were last written
(``FLUSH`` at most), not the whole model, so it does not grow with the rounds. Lost executors cost
re-reading blocks from the shared folder.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol,
                                     HasStepSize, HasWeightCol)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.cells import ROWS, cell_table
from trellis.session import cut_lineage

#: rounds between two rewrites of the blocks' margins
FLUSH = 10
#: task results that are added up on the driver at once; beyond that tasks add them first
DRIVER_SUMS = 64
#: rows in a block
BLOCK_ROWS = 50_000

BLOCK = "n long, bins binary, y binary, w binary, margin binary"


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol, HasMaxIter, HasStepSize):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "cut points of a feature plus one, up to 256", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "penalty on leaf values", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least curvature of a child", TypeConverters.toFloat)
    minSplitGain = Param(Params._dummy(), "minSplitGain", "least gain of a split", TypeConverters.toFloat)


# ------------------------------------------------------------------ trees as arrays

def _leaves(bins: np.ndarray, tree: dict) -> np.ndarray:
    """The leaf (0 .. 2^depth - 1) of every row; a node without a split sends all rows left."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for feature, cut in tree["levels"]:
        at = np.asarray(feature)[node]
        right = (at >= 0) & (bins[rows, np.maximum(at, 0)] > np.asarray(cut)[node])
        node = 2 * node + right
    return node


def _margins(bins: np.ndarray, margin: np.ndarray, trees: list) -> np.ndarray:
    for tree in trees:
        margin = margin + np.asarray(tree["leaves"])[_leaves(bins, tree)]
    return margin


def best_splits(sums: np.ndarray, reg: float, least: float, gain_over: float) -> list:
    """``(feature, bin, gain, left (G, H), right (G, H))`` of every node, or None, from
    ``sums[node, feature, bin, (g, h)]``. Ties go to the first feature, then the lowest bin."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums.sum(axis=2)[:, :, None, :]
    right = total - left
    value = lambda x: x[..., 0] ** 2 / (x[..., 1] + reg)
    gain = value(left) + value(right) - value(total)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, -np.inf)
    out = []
    for node in range(len(sums)):
        flat = int(np.argmax(gain[node]))
        f, b = divmod(flat, gain.shape[2])
        ok = gain.shape[2] and gain[node, f, b] > max(gain_over, 1e-6)
        out.append((f, b, float(gain[node, f, b]), left[node, f, b], right[node, f, b]) if ok else None)
    return out


# ------------------------------------------------------------------ passes over the blocks

def _unpack(row, d: int):
    bins = np.frombuffer(row.bins, np.uint8).reshape(-1, d)
    return bins, np.frombuffer(row.y, np.float64), np.frombuffer(row.w, np.float64), np.frombuffer(row.margin, np.float64)


def _packer(cuts: list[np.ndarray]):
    def pack(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1)
            if not np.isfinite(x).all():
                raise ValueError("boosted trees need finite features: impute NULL and NaN first")
            bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            y, w = pdf["y"].to_numpy(np.float64), pdf["w"].to_numpy(np.float64)
            for s in range(0, len(pdf), BLOCK_ROWS):
                e = slice(s, s + BLOCK_ROWS)
                yield pd.DataFrame({"n": [len(y[e])], "bins": [bins[e].tobytes()], "y": [y[e].tobytes()], "w": [w[e].tobytes()],
                                    "margin": [np.zeros(len(y[e])).tobytes()]})
    return pack


def _histogram(d: int, n_bins: int, pending: list, levels: list):
    """A task's sums of (g, h) by (node, feature, bin) at the next level of the tree that has ``levels``."""
    nodes = 2 ** len(levels)

    def run(batches):
        sums = np.zeros((2, nodes * d * n_bins))
        offset = np.arange(d) * n_bins
        for pdf in batches:
            for row in pdf.itertuples():
                bins, y, w, margin = _unpack(row, d)
                p = 1.0 / (1.0 + np.exp(-_margins(bins, margin, pending)))
                at = (_leaves(bins, {"levels": levels})[:, None] * (d * n_bins) + offset + bins).ravel()
                for i, v in enumerate((w * (p - y), w * p * (1.0 - p))):
                    sums[i] += np.bincount(at, weights=np.repeat(v, d), minlength=sums.shape[1])
        yield pd.DataFrame({"sums": [sums.tobytes()]})
    return run


def _added(batches):
    total = None
    for pdf in batches:
        for raw in pdf["sums"]:
            part = np.frombuffer(raw)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"sums": [total.tobytes()]})


def _moved(d: int, pending: list):
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                bins, _, _, margin = _unpack(row, d)
                out.append(_margins(bins, margin, pending).tobytes())
            yield pdf.assign(margin=out)
    return run


def _sum_over(blocks: DataFrame, tasks: int, pass_) -> np.ndarray:
    parts = blocks.mapInPandas(pass_, "sums binary")
    if tasks > DRIVER_SUMS:
        parts = parts.repartition(int(np.ceil(np.sqrt(tasks)))).mapInPandas(_added, "sums binary")
    return sum(np.frombuffer(r["sums"]) for r in parts.collect())


# ------------------------------------------------------------------ estimator and model

class NewtonBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of second-order boosted trees, see the module."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, predictionCol="prediction",
                 probabilityCol="probability", maxIter=100, maxDepth=6, stepSize=0.3, maxBins=256, regLambda=1.0,
                 minChildWeight=1.0, minSplitGain=0.0):
        super().__init__()
        self._setDefault(maxIter=100, maxDepth=6, stepSize=0.3, maxBins=256, regLambda=1.0, minChildWeight=1.0, minSplitGain=0.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setWeightCol(self, value: str) -> "NewtonBoosting":
        return self._set(weightCol=value)

    def _fit(self, dataset: DataFrame) -> "NewtonBoostingModel":
        get = self.getOrDefault
        weight = F.col(get(self.weightCol)).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        rows = dataset.select(vector_to_array(F.col(get(self.featuresCol))).alias("x"),
                              F.col(get(self.labelCol)).cast("double").alias("y"), weight.alias("w"))
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        d = first[0]
        n_bins = min(get(self.maxBins), 256)
        cuts = cut_points(rows, d, n_bins)
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        met = as_cells(rows, cuts) if rows.count() > ROWS else None
        if met is not None:   # a task for every block
            cells, n_cells = met
            packed = cells.repartition(max(1, min(cores, n_cells // BLOCK_ROWS))).mapInPandas(
                _packer([np.arange(len(c), dtype=float) for c in cuts]), BLOCK)
        else:
            packed = (rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)).mapInPandas(_packer(cuts), BLOCK)
        blocks = cut_lineage(packed, "boost-blocks")
        tasks, trees, pending = blocks.rdd.getNumPartitions(), [], []
        gains = np.zeros(d)
        for _ in range(get(self.maxIter)):
            tree = self._tree(blocks, tasks, d, n_bins, pending, gains)
            trees.append(tree)
            pending.append(tree)
            if len(pending) == FLUSH:
                blocks, pending = cut_lineage(blocks.mapInPandas(_moved(d, pending), BLOCK), "boost-blocks"), []
        saved = [{"levels": [([int(f) for f in feature], [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(feature, cut)])
                             for feature, cut in t["levels"]], "leaves": [float(v) for v in t["leaves"]]} for t in trees]
        model = NewtonBoostingModel(trees=json.dumps(saved), gains=gains.tolist())
        return self._copyValues(model)

    def _tree(self, blocks: DataFrame, tasks: int, d: int, n_bins: int, pending: list, gains: np.ndarray) -> dict:
        get = self.getOrDefault
        reg, eta = get(self.regLambda), get(self.stepSize)
        levels: list = []
        value = np.zeros(1)          # of the nodes at the current level; kept by those that do not split
        splits_left = np.ones(1, bool)
        for depth in range(get(self.maxDepth)):
            sums = _sum_over(blocks, tasks, _histogram(d, n_bins, pending, levels)).reshape(2, 2 ** depth, d, n_bins)
            sums = np.moveaxis(sums, 0, -1)
            if depth == 0:
                g, h = sums[0, 0].sum(axis=0)
                value = np.array([-eta * g / (h + reg)])
            found = best_splits(sums, reg, get(self.minChildWeight), get(self.minSplitGain))
            found = [s if ok else None for s, ok in zip(found, splits_left)]
            if not any(found):
                break
            levels.append(([s[0] if s else -1 for s in found], [s[1] if s else 0 for s in found]))
            for s in found:
                if s:
                    gains[s[0]] += s[2]
            value = np.array([v for i, s in enumerate(found) for v in
                              ((-eta * s[3][0] / (s[3][1] + reg), -eta * s[4][0] / (s[4][1] + reg)) if s else (value[i], value[i]))])
            splits_left = np.repeat([s is not None for s in found], 2)
        return {"levels": levels, "leaves": value}


def cut_points(rows: DataFrame, d: int, n_bins: int) -> list[np.ndarray]:
    """Sorted cut points of every element of ``x``: a row is left of a cut if its value is at most the cut.
    One aggregate; values beyond the last cut share the last bin."""
    probs = [float(p) for p in np.linspace(0, 1, n_bins + 1)[1:-1]]
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], probs, 20 * n_bins).alias(f"q{i}") for i in range(d)]).first()
    return [np.unique(np.asarray(q, float)) for q in found]


def as_cells(rows: DataFrame, cuts: list[np.ndarray]) -> tuple[DataFrame, int] | None:
    """Rows that agree in bins, label and weight as one row ``x, y, w`` with bin numbers and summed weight, and their
    number; None if that is more than a quarter of the rows."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | F.abs(v).isin(float("inf")))
    if rows.where(bad).limit(1).count():
        raise ValueError("boosted trees need finite features: impute NULL and NaN first")
    cells = cell_table(rows, [c.tolist() for c in cuts])
    counts = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows")).first()
    if counts["cells"] > counts["rows"] // 4:
        return None
    x = F.array(*[F.col(f"b{i}").cast("double") for i in range(len(cuts))])
    return cells.select(x.alias("x"), "y", (F.col("w") * F.col("n")).alias("w")), counts["cells"]


class NewtonBoostingModel(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; ``probability`` is ``[1 - p, p]``, ``prediction`` is 1.0 where p is at least 0.5."""

    trees = Param(Params._dummy(), "trees", "splits by level and leaf values, as JSON", TypeConverters.toString)
    gains = Param(Params._dummy(), "gains", "total gain by feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, trees="[]", gains=()):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", probabilityCol="probability")
        self._set(trees=trees, gains=list(gains))

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.gains))

    def first_split(self) -> tuple[int, float]:
        feature, cut = json.loads(self.getOrDefault(self.trees))[0]["levels"][0]
        return feature[0], cut[0]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault(self.trees))  # the model's size

        @F.pandas_udf("double")
        def margin(batches: "pd.Series") -> "pd.Series":
            x = np.array(batches.tolist(), float).reshape(len(batches), -1)
            return pd.Series(_margins(x, np.zeros(len(x)), json.loads(shared.value)))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin")))
        out = dataset.withColumn("_margin", margin(vector_to_array(F.col(self.getOrDefault(self.featuresCol)))))
        return out.withColumn(self.getOrDefault(self.probabilityCol), array_to_vector(F.array(F.lit(1.0) - p, p))) \
            .withColumn(self.getOrDefault(self.predictionCol), (F.col("_margin") >= 0).cast("double")).drop("_margin")
