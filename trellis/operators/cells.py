"""Tree learners on cells: rows that agree in bins, label and weight are learnt as one row with a count.

A tree of ``maxBins`` bins sees a row's bins only, so the table of distinct ``(bins, label, weight)``
with their number of rows holds all that it can learn from. Spark builds it in two passes over the
rows, whatever the number of trees, rounds and levels; every later pass reads the cells, of which there are at
most ``bins ** features`` a label and weight.

* Boosted trees: the rounds of Spark's learner on the cells, weighted by their rows. Without subsampling this is the same
  sum of gradients in every bin as over the rows. Rounds follow one another, so up to ``BOOST_CELLS`` cells
  one task grows them all, without a Spark job for every level; more cells go to Spark's own learner.
* Forests: a bootstrap draws every row by Poisson(1), hence a cell of n rows by Poisson(n). Trees grow apart,
  one task a tree at a time, on the shared cells. Feature subsets, least rows of a node, gains
  and merged leaves follow Spark's forest; the fitted trees come back as Spark's own model.
* Folds of a cross-validation are summed together (``FoldCells``): the passes over the rows do not grow with their number.

Tables of at most ``ROWS`` rows are learnt row by row by Spark's learners, and so are tables whose cells
are no real saving (more than a quarter of the rows, or, for forests, more than ``FOREST_CELLS``).
"""

from __future__ import annotations

import json
import math
import threading
import uuid
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.wrapper import JavaEstimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.session import checkpoint_dir, cut_lineage, track

#: rows that Spark's learners take as they are
ROWS = 100_000
#: most cells that the tasks of a forest share
FOREST_CELLS = 1 << 20
#: most cells that a task boosts
BOOST_CELLS = 1 << 17
#: nodes whose sums a growing tree holds at once
NODES = 2_048


def bin_cuts(rows: DataFrame, d: int, max_bins: int) -> list[list[float]]:
    """Sorted cut points of every element of ``x``; a row is left of a cut if its value is at most the cut. A
    feature of at most ``max_bins`` values is cut between all of them, any other one by approximate quantiles."""
    return part_cuts(rows, d, max_bins, [F.lit(True)])[0]


def part_cuts(rows: DataFrame, d: int, max_bins: int, parts: Sequence[Column], fill: Sequence | None = None) -> list[list[list[float]]]:
    """``bin_cuts`` of parts of the rows, each given by its condition, in as many passes as for a single one. ``fill`` has the
    values that stand for NULL in each part."""
    def element(p: int, i: int) -> Column:
        x = F.col("x")[i]
        return F.when(parts[p], x if fill is None else F.coalesce(x, F.lit(float(fill[p][i]))))
    probs = [i / max_bins for i in range(1, max_bins)]
    every = [(p, i) for p in range(len(parts)) for i in range(d)]

    def found(sets, quantiles):
        x = lambda c: element(*c)
        aggs = [F.collect_set(x(c)).alias(f"s{c[0]}_{c[1]}") for c in sets] \
            + [F.percentile_approx(x(c), probs, 20 * max_bins).alias(f"q{c[0]}_{c[1]}") for c in quantiles]
        row = rows.agg(*aggs).first() if aggs else None
        return [{c: sorted(set(row[f"{tag}{c[0]}_{c[1]}"] or [])) for c in which} for tag, which in (("s", sets), ("q", quantiles))]
    whole = rows.agg(*[F.approx_count_distinct(F.col("x")[i]).alias(f"n{i}") for i in range(d)]).first()
    many = [(p, i) for p, i in every if whole[f"n{i}"] > 2 * max_bins]   # the count is good to a few per cent
    counts = rows.agg(*[F.approx_count_distinct(element(p, i)).alias(f"n{p}_{i}") for p, i in many]).first() \
        if many and len(parts) > 1 else {f"n{p}_{i}": whole[f"n{i}"] for p, i in many}
    few = [c for c in every if c not in many or counts[f"n{c[0]}_{c[1]}"] <= 2 * max_bins]
    values, cuts = found(few, [c for c in every if c not in few])
    cuts |= found([], [c for c in few if len(values[c]) > max_bins])[1]
    cuts |= {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c, v in values.items() if len(v) <= max_bins}
    return [[cuts[p, i] for i in range(d)] for p in range(len(parts))]


def _bin(x: Column, cuts: list[float], low: int = 0) -> Column:
    """Number of cuts below ``x``, by halving."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(x <= F.lit(float(cuts[mid])), _bin(x, cuts[:mid], low)).otherwise(_bin(x, cuts[mid + 1:], low + mid + 1))


def binned(x: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``x`` with ``b0..`` for ``x0..``: the number of cuts below the value, all of them for NaN and NULL. Finite cuts are
    searched by Spark's bucketizer, as long nested conditions are more than the JVM compiles. Its
    buckets hold their lower end, ours the upper one, hence the negative values; ``0.0 - x`` is never -0.0."""
    plain = [i for i, c in enumerate(cuts) if c and all(map(math.isfinite, c))]
    if plain:
        x = Bucketizer(splitsArray=[[-math.inf, *sorted(0.0 - v for v in cuts[i]), math.inf] for i in plain], handleInvalid="keep",
                       inputCols=[f"_m{i}" for i in plain], outputCols=[f"_k{i}" for i in plain]) \
            .transform(x.select("*", *[(F.lit(0.0) - F.col(f"x{i}")).alias(f"_m{i}") for i in plain]))

    def number(i: int, c: list[float]) -> Column:
        v = F.col(f"x{i}")
        if i not in plain:
            return _bin(v, c)
        return F.when(v.isNull() | F.isnan(v), len(c)).otherwise(F.lit(len(c)) - F.col(f"_k{i}").cast("int"))
    return x.select("*", *[number(i, c).alias(f"b{i}") for i, c in enumerate(cuts)]).drop(*[f"{t}{i}" for t in ("_m", "_k") for i in plain])


def cell_table(rows: DataFrame, cuts: list[list[float]], *more: str) -> DataFrame:
    """``b0.., y, w, more.., n``: rows by bins, label, weight and the columns ``more``, written once."""
    x = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(len(cuts))], "y", "w", *more)
    bins = binned(x, cuts).select(*[f"b{i}" for i in range(len(cuts))], "y", "w", *more)
    return cut_lineage(bins.groupBy(*bins.columns).agg(F.count(F.lit(1)).alias("n")), "cells")


def learner_rows(dataset: DataFrame, est, *more: Column) -> DataFrame:
    """``x, y, w, more..`` of a learner's training rows."""
    has_weight = est.isDefined(est.weightCol) and est.getOrDefault(est.weightCol)
    weight = F.col(est.getOrDefault(est.weightCol)).cast("double") if has_weight else F.lit(1.0)
    return dataset.select(vector_to_array(F.col(est.getOrDefault(est.featuresCol))).alias("x"),
                          F.col(est.getOrDefault(est.labelCol)).cast("double").alias("y"), weight.alias("w"), *more)


def takes_cells(est) -> bool:
    """Whether ``est`` can learn from cells, if there are few enough."""
    return isinstance(est, CellTrees) and est.getOrDefault("subsamplingRate") == 1.0 and est._by_cells()


def reads_cells(learner, rows: DataFrame) -> bool:
    """Whether ``learner`` reads ``rows`` a fixed number of times only."""
    from trellis.operators.boosting import NewtonBoosting
    return isinstance(learner, (CellTrees, NewtonBoosting)) and rows.count() > ROWS


def with_nodes(model, nodes: DataFrame, weights: list[float] | None = None):
    """``model`` with the trees of ``nodes``, the rows of Spark's saved node table. With ``weights``, one a tree, the
    model may have had another number of trees."""
    spark = nodes.sparkSession
    path = track(f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes.write.mode("overwrite").parquet(f"{path}/data")
    if weights is not None:
        about = spark.read.parquet(f"{path}/treesMetadata")
        text = about.first()[1]                    # tree, its parameters, weight
        about = spark.createDataFrame([(i, text, w) for i, w in enumerate(weights)], about.schema)
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/treesMetadata")
        saved = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        spark.createDataFrame([(json.dumps(saved | {"numTrees": len(weights)}),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/metadata")
    return type(model).load(path)


#: nodes of grown trees, and their form in Spark's saved table
NODE = ("tree int, id int, prediction double, impurity double, stats array<double>, raw long, gain double, "
        "l int, r int, feature int, cut double")


def saved_nodes(grown: DataFrame) -> DataFrame:
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("cut")).otherwise(
        F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    return grown.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain",
        F.col("l").alias("leftChild"), F.col("r").alias("rightChild"), split.alias("split")).alias("nodeData"))


class CellTrees:
    """Mixin of Spark's tree estimators: ``fit`` learns from cells where they are a saving."""

    def _fit(self, dataset: DataFrame):
        n = dataset.count()
        if n > ROWS and takes_cells(self):
            rows = learner_rows(dataset, self)
            cuts = bin_cuts(rows, len(rows.first()["x"]), self.getOrDefault("maxBins"))
            cells = cell_table(rows, cuts)
            n_cells = cells.count()
            if n_cells <= min(n // 4, self._most_cells):
                return self._from_cells(cells, n_cells, cuts)
        return super()._fit(dataset)

    def _from_cells(self, cells: DataFrame, n_cells: int, cuts: list):
        if cells.where(F.col("y").isNull() | F.isnan("y") | F.col("w").isNull() | ~(F.col("w") >= 0)).limit(1).count():
            raise ValueError("tree learners need a label and a weight of at least 0 in every row")
        model = self._fit_cells(cells, n_cells, cuts)
        for p in model.params:
            if model.isSet(p) and not (self.hasParam(p.name) and self.isSet(p.name)):
                model.clear(p)
        return self._copyValues(model)

    def _learn(self, cells: DataFrame, n_cells: int, cuts: list, **params):
        """Spark's learner on the cells, with bin numbers as features."""
        vector = array_to_vector(F.array(*[F.col(f"b{i}").cast("double") for i in range(len(cuts))]))
        rows = cells.select(vector.alias(self.getOrDefault("featuresCol")), F.col("y").alias(self.getOrDefault("labelCol")),
                            (F.col("w") * F.col("n")).alias("_cell_weight")).coalesce(max(1, n_cells // 50_000))
        # Spark looks at the square of maxBins rows for its splits: at all cells
        est = self.copy()
        est._set(weightCol="_cell_weight", maxBins=max(self.getOrDefault("maxBins"), math.isqrt(n_cells) + 1), **params)
        return JavaEstimator._fit(est, rows)


class CellGBTClassifier(CellTrees, GBTClassifier):
    """Boosted trees on cells."""

    _most_cells = 1 << 62

    def _by_cells(self) -> bool:
        return self.getOrDefault("minInstancesPerNode") == 1   # a cell is at least one row

    def _fit_cells(self, cells: DataFrame, n_cells: int, cuts: list):
        if n_cells <= BOOST_CELLS and self._plain():
            return self._fit_rounds(cells, n_cells, cuts)
        model = self._learn(cells, n_cells, cuts)
        path = track(f"{checkpoint_dir(cells.sparkSession).rstrip('/')}/trees-{uuid.uuid4().hex}")
        model.write().overwrite().save(path)
        # a split between bins k and k + 1 is at cut k
        table = F.array(*[F.array(*[F.lit(float(v)) for v in c] or [F.lit(None).cast("double")]) for c in cuts])
        at = F.col("nodeData.split")
        cut = F.get(F.get(table, at["featureIndex"]), F.floor(at["leftCategoriesOrThreshold"][0]).cast("int"))
        split = at.withField("leftCategoriesOrThreshold", F.when(at["featureIndex"] >= 0, F.array(cut)).otherwise(
            at["leftCategoriesOrThreshold"]))
        nodes = cells.sparkSession.read.parquet(f"{path}/data")
        return with_nodes(model, nodes.withColumn("nodeData", F.col("nodeData").withField("split", split)))

    def _plain(self) -> bool:
        """Whether ``boost`` knows all that is asked for."""
        get = self.getOrDefault
        return get("featureSubsetStrategy") == "all" and get("minWeightFractionPerNode") == 0.0 and get("lossType") == "logistic" \
            and not (self.isDefined("validationIndicatorCol") and get("validationIndicatorCol"))

    def _fit_rounds(self, cells: DataFrame, n_cells: int, cuts: list):
        get, d = self.getOrDefault, len(cuts)
        template = self._learn(cells, n_cells, cuts, maxDepth=0, maxIter=1)
        names = [*[f"b{i}" for i in range(d)], "y", "w"]
        options = dict(cuts=cuts, depth=get("maxDepth"), gain_over=get("minInfoGain"), step=get("stepSize"), rounds=get("maxIter"))

        def run(batches):
            parts = list(batches)
            if parts:   # sorted, so that sums do not depend on the order in which cells were written
                t = pd.concat(parts).sort_values(names, ignore_index=True)
                yield from boost(t[names[:d]].to_numpy(np.int64), *(t[c].to_numpy(float) for c in ("y", "w", "n")), **options)
        grown = cells.select(*names, "n").repartition(1).mapInPandas(run, NODE)   # at most BOOST_CELLS rows
        return with_nodes(template, saved_nodes(grown), [1.0] + [get("stepSize")] * (get("maxIter") - 1))


class _CellForest(CellTrees):
    _most_cells = FOREST_CELLS

    def _by_cells(self) -> bool:
        subset = self.getOrDefault("featureSubsetStrategy")
        return subset in ("sqrt", "all") and self.getOrDefault("minWeightFractionPerNode") == 0.0

    def _fit_cells(self, cells: DataFrame, n_cells: int, cuts: list):
        get, spark = self.getOrDefault, cells.sparkSession
        template = self._learn(cells, n_cells, cuts, maxDepth=0, cacheNodeIds=False)
        d, trees = len(cuts), get("numTrees")
        # sorted, so that the draws do not depend on the order in which cells were written
        names = [*[f"b{i}" for i in range(d)], "y", "w"]
        table = cells.where("w > 0").toPandas().sort_values(names, ignore_index=True)
        shared = spark.sparkContext.broadcast((table[names[:d]].to_numpy(np.uint16), table["y"].to_numpy(float),
                                               table["w"].to_numpy(float), table["n"].to_numpy(np.int64)))
        classes = template.numClasses if hasattr(template, "numClasses") else 0
        options = dict(cuts=cuts, classes=classes, depth=get("maxDepth"), least=get("minInstancesPerNode"), gain_over=get("minInfoGain"),
                       subset=d if get("featureSubsetStrategy") == "all" else math.ceil(math.sqrt(d)), bootstrap=get("bootstrap"))
        seed = get("seed")

        def run(batches):
            for pdf in batches:
                for tree in pdf["tree"]:
                    yield grow(int(tree), seed, *shared.value, **options)
        tasks = min(trees, 4 * spark.sparkContext.defaultParallelism)
        grown = spark.range(0, trees, 1, tasks).select(F.col("id").alias("tree")).mapInPandas(run, NODE)
        return with_nodes(template, saved_nodes(grown))


class CellForestClassifier(_CellForest, RandomForestClassifier):
    """Random forest on cells."""


class CellForestRegressor(_CellForest, RandomForestRegressor):
    """Forest regressor on cells."""


# ------------------------------------------------------------------ folds

class FoldCells:
    """Cells of the training and held-out rows of all folds, from one set of passes over the rows. Every fold has the cuts
    of its own training rows. The rows are summed once, by fold and by the bins between the cuts of all folds, which lie
    each in one bin of any fold: a fold's training cells are sums of them, and its held-out rows of one such bin
    get the same prediction."""

    def __init__(self, est: CellTrees, dataset: DataFrame, fold_col: str, k: int, sizes: list[int]):
        rows = learner_rows(dataset, est, F.col(fold_col).alias("fold"))
        self.est, self.sizes = est, sizes
        self.d = len(rows.first()["x"])
        self.cuts = part_cuts(rows, self.d, est.getOrDefault("maxBins"), [F.col("fold") != f for f in range(k)])
        self.merged = [sorted(set().union(*[c[i] for c in self.cuts])) for i in range(self.d)]
        self.cells = cell_table(rows, self.merged, "fold")
        self._parts: dict[int, tuple[DataFrame, int]] = {}
        self._locks = [threading.Lock() for _ in range(k)]

    @staticmethod
    def of(est, dataset: DataFrame, fold_col: str, k: int) -> "FoldCells | None":
        """The cells of ``est``'s folds, or None where it takes rows."""
        if not takes_cells(est):
            return None
        held = {r[0]: r[1] for r in dataset.where(F.col(fold_col).isNotNull()).groupBy(fold_col).count().collect()}
        sizes = [sum(held.values()) - held.get(f, 0) for f in range(k)]
        return FoldCells(est, dataset, fold_col, k, sizes) if min(sizes) > ROWS else None

    def _by_bin(self, values: list, i: int) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col(f"b{i}"))

    def part(self, f: int) -> tuple[DataFrame, int]:
        """The training cells of fold ``f`` and their number, summed once."""
        with self._locks[f]:
            if f not in self._parts:
                bins = [self._by_bin([bisect_left(c, u) for u in m] + [len(c)], i).alias(f"b{i}")
                        for i, (c, m) in enumerate(zip(self.cuts[f], self.merged))]
                part = self.cells.where(F.col("fold") != f).select(*bins, "y", "w", "n")
                cells = cut_lineage(part.groupBy(*[c for c in part.columns if c != "n"]).agg(F.sum("n").alias("n")), "cells")
                self._parts[f] = cells, cells.count()
            return self._parts[f]

    def fit(self, f: int, est: CellTrees | None = None):
        """The model of the rows outside fold ``f``, or None where their cells are no real saving. ``est`` may be a copy of the
        folds' estimator with other parameters, but the same columns and bins."""
        est, (cells, n_cells) = est or self.est, self.part(f)
        if n_cells > min(self.sizes[f] // 4, est._most_cells):
            return None
        return est._from_cells(cells, n_cells, self.cuts[f])

    def held(self, f: int) -> DataFrame:
        """Features, label and number ``n`` of the rows of fold ``f``, with a value of its bin for every feature."""
        x = [self._by_bin([float(u) for u in m] + [math.nextafter(m[-1], math.inf) if m else 0.0], i) for i, m in enumerate(self.merged)]
        return self.cells.where(F.col("fold") == f).select(
            array_to_vector(F.array(*x)).alias(self.est.getOrDefault("featuresCol")),
            F.col("y").alias(self.est.getOrDefault("labelCol")), "n")


# ------------------------------------------------------------------ subsets

class SubsetCells:
    """Cells of the nested training subsets of a learning curve. ``rows`` has ``fold``, ``level`` (0 for the shortest subset that
    holds the row), ``y`` and ``x``; subset ``(f, j)`` is all rows outside fold ``f`` up to level ``last[f, j]``. NULL features
    stay apart, so that each subset reads its own median for them. The passes over the rows are two or three for the cuts of
    all subsets and one a fold for its cells."""

    def __init__(self, est: CellTrees, rows: DataFrame, d: int, last: dict, fill: dict):
        self.est, self.rows, self.d, self.last, self.fill = est, rows, d, last, fill
        inside = [~F.col("fold").eqNullSafe(F.lit(f)) & (F.col("level") <= n) for (f, _), n in last.items()]
        cuts = part_cuts(rows, d, est.getOrDefault("maxBins"), inside, [fill[t] for t in last])
        self.cuts = dict(zip(last, cuts))
        self.merged, self.folds = {}, {}

    def sum_fold(self, f: int) -> None:
        """Cells of the fold's held-out and training rows, by the first of its subsets that has them."""
        mine = sorted({n for t, n in self.last.items() if t[0] == f})
        self.merged[f] = m = [sorted(set().union(*[c[i] for t, c in self.cuts.items() if t[0] == f])) for i in range(self.d)]
        held = F.col("fold").eqNullSafe(F.lit(f))
        step = sum((F.when(F.col("level") > n, 1).otherwise(0) for n in mine), F.lit(0))
        rows = self.rows.where(held | (F.col("level") <= mine[-1])).select(
            "x", "y", F.lit(1.0).alias("w"), held.alias("held"), F.when(held, 0).otherwise(step).alias("step"),
            *[F.col("x")[i].isNull().alias(f"z{i}") for i in range(self.d)])
        self.folds[f] = cell_table(rows, m, "held", "step", *[f"z{i}" for i in range(self.d)]), mine

    def _binned(self, t, held: bool) -> DataFrame:
        """``b0.., y, n`` with the bins of subset ``t``: its own cells or those of its fold's held-out rows."""
        (cells, mine), cuts, fill = self.folds[t[0]], self.cuts[t], self.fill[t]
        rows = cells.where(F.col("held") if held else ~F.col("held") & (F.col("step") <= mine.index(self.last[t])))

        def number(i: int) -> Column:
            own = [bisect_left(cuts[i], u) for u in self.merged[t[0]][i]] + [len(cuts[i])]
            return F.when(F.col(f"z{i}"), bisect_left(cuts[i], fill[i])).otherwise(F.get(F.array(*[F.lit(v) for v in own]), F.col(f"b{i}")))
        bins = rows.select(*[number(i).alias(f"b{i}") for i in range(self.d)], "y", "n")
        return bins.groupBy(*[c for c in bins.columns if c != "n"]).agg(F.sum("n").alias("n"))

    def fit(self, t, size: int, weights):
        """The model of subset ``t`` and ``(features, label, n)`` of its own and of the held-out rows, or None where its cells are no
        real saving. ``weights`` gives a weight for every label from the labels' counts."""
        own = cut_lineage(self._binned(t, False), "cells")
        n_cells = own.count()
        if n_cells > min(size // 4, self.est._most_cells):
            return None
        counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.sum("n").alias("n")).collect()}
        w = F.lit(None).cast("double")
        for y, v in weights(counts).items():
            w = F.when(F.col("y") == F.lit(y), F.lit(float(v))).otherwise(w)
        names = [f"b{i}" for i in range(self.d)]
        model = self.est._from_cells(own.select(*names, "y", w.alias("w"), "n"), n_cells, self.cuts[t])
        values = [[*c, math.nextafter(c[-1], math.inf) if c else 0.0] for c in self.cuts[t]]
        x = array_to_vector(F.array(*[F.get(F.array(*[F.lit(float(v)) for v in u]), F.col(f"b{i}")) for i, u in enumerate(values)]))
        named = [x.alias(self.est.getOrDefault("featuresCol")), F.col("y").alias(self.est.getOrDefault("labelCol")), "n"]
        return model, own.select(*named), self._binned(t, True).select(*named)


# ------------------------------------------------------------------ one tree

def _impurity(s: np.ndarray, by_class: bool) -> np.ndarray:
    """Gini impurity of class weights, or the variance from (weight, sum, sum of squares); the last entry is not used."""
    total = _weight(s, by_class)
    safe = np.where(total > 0, total, 1.0)
    if by_class:
        return np.where(total > 0, 1.0 - ((s[..., :-1] / safe[..., None]) ** 2).sum(-1), 0.0)
    return np.maximum(s[..., 2] / safe - (s[..., 1] / safe) ** 2, 0.0)


def _weight(s: np.ndarray, by_class: bool) -> np.ndarray:
    return s[..., :-1].sum(-1) if by_class else s[..., 0]


def _best(node, bins, stats, total, allowed, sizes, by_class, least):
    """Feature, bin and gain of the best split of every node; ``node`` numbers the cells' nodes from 0."""
    m, s = len(total), stats.shape[1]
    feature, cut, best = np.full(m, -1), np.zeros(m, int), np.full(m, -np.inf)
    whole, impurity = np.maximum(_weight(total, by_class), 1e-300), _impurity(total, by_class)
    for f, nb in enumerate(sizes):
        if nb < 2:
            continue
        at = node * nb + bins[:, f]
        sums = np.stack([np.bincount(at, stats[:, j], m * nb).reshape(m, nb) for j in range(s)], -1)
        left = np.cumsum(sums, 1)[:, :-1]
        right = total[:, None] - left
        gain = impurity[:, None] - (_weight(left, by_class) * _impurity(left, by_class)
                                    + _weight(right, by_class) * _impurity(right, by_class)) / whole[:, None]
        # rows are whole numbers; the cells' sums of them are exact
        gain[~(allowed[:, f, None] & (left[..., -1] >= least) & (right[..., -1] >= least))] = -np.inf
        b = gain.argmax(1)
        g = gain[np.arange(m), b]
        better = g > best
        feature[better], cut[better], best[better] = f, b[better], g[better]
    return feature, cut, best


def grow(tree, seed, bins, y, w, n, cuts, classes, depth, least, gain_over, subset, bootstrap) -> pd.DataFrame:
    """Nodes of one tree, level by level, in Spark's saved form (numbered from the root, left before right)."""
    rng = np.random.default_rng([seed % (1 << 63), tree])
    bag = rng.poisson(n) if bootstrap else n
    bins, y, w, bag = (a[bag > 0] for a in (bins.astype(np.int64), y, w, bag))
    weight = w * bag
    parts = [weight * (y == c) for c in range(classes)] if classes else [weight, weight * y, weight * y * y]
    stats = np.stack([*parts, bag.astype(float)], 1)
    return _saved(tree, *_tree(rng, bins, stats, cuts, classes > 0, depth, least, gain_over, subset), cuts)


def boost(bins, y, w, n, cuts, depth, gain_over, step, rounds):
    """Nodes of one tree a round: Spark's rounds for the logistic loss, with margins that start from a tree of the labels."""
    sign, margin, weight = 2.0 * y - 1.0, np.zeros(len(y)), w * n
    for m in range(rounds):
        target = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin)) if m else sign
        stats = np.stack([weight, weight * target, weight * target * target, n], 1)
        total, impurity, feature, cut, gain, left, prediction = _tree(None, bins, stats, cuts, False, depth, 1, gain_over, len(cuts))
        node, rows = np.zeros(len(y), np.int64), np.arange(len(y))
        for _ in range(depth):
            node = np.where(left[node] >= 0, left[node] + (bins[rows, feature[node]] > cut[node]), node)
        margin += (step if m else 1.0) * prediction[node]
        yield _saved(m, total, impurity, feature, cut, gain, left, prediction, cuts)


def _tree(rng, bins, stats, cuts, by_class, depth, least, gain_over, subset):
    """Totals, impurity, feature, cut, gain, left child and prediction of a tree's nodes, level by level."""
    d, sizes, total = len(cuts), [len(c) + 1 for c in cuts], stats.sum(0)[None]
    node = np.zeros(len(stats), np.int64)          # number in the level; cells of finished nodes are left out
    levels, first = [], 0                          # every level's totals, feature, cut, gain and left child
    for level in range(depth + 1):
        m = len(total)
        feature, cut, gain = np.full(m, -1), np.zeros(m, int), np.full(m, -1.0)
        impurity = _impurity(total, by_class)
        if level < depth and len(node):
            order = np.argsort(node, kind="stable")
            node, bins, stats = node[order], bins[order], stats[order]
            allowed = np.argsort(np.argsort(rng.random((m, d)), 1), 1) < subset if subset < d else np.ones((m, d), bool)
            for a in range(0, m, NODES):
                e = min(a + NODES, m)
                i, j = np.searchsorted(node, [a, e])
                feature[a:e], cut[a:e], gain[a:e] = _best(node[i:j] - a, bins[i:j], stats[i:j], total[a:e], allowed[a:e], sizes,
                                                          by_class, least)
            stop = ~((gain > 1e-12 * impurity) & (gain >= gain_over) & (impurity > 1e-15))
            feature[stop], gain[stop] = -1, -1.0
        rank = np.cumsum(feature >= 0) - 1
        levels.append((total, impurity, feature, cut, gain, np.where(feature >= 0, first + m + 2 * rank, -1)))
        first += m
        if not (feature >= 0).any():
            break
        go = feature[node] >= 0
        node, bins, stats = node[go], bins[go], stats[go]
        right = bins[np.arange(len(node)), feature[node]] > cut[node]
        node = 2 * rank[node] + right
        total = np.stack([np.bincount(node, stats[:, k], 2 * (rank[-1] + 1)) for k in range(stats.shape[1])], 1)
    total, impurity, feature, cut, gain, left = (np.concatenate(x) for x in zip(*levels))
    if by_class:
        prediction = total[:, :-1].argmax(1).astype(float)
    else:
        prediction = total[:, 1] / np.where(total[:, 0] > 0, total[:, 0], 1.0)
    return total, impurity, feature, cut, gain, left, prediction


def _saved(tree, total, impurity, feature, cut, gain, left, prediction, cuts) -> pd.DataFrame:
    size = np.ones(len(left), np.int64)
    for i in range(len(left) - 1, -1, -1):         # children come after their parents
        a = left[i]
        if a < 0:
            continue
        if left[a] < 0 and left[a + 1] < 0 and prediction[a] == prediction[a + 1]:
            left[i], feature[i], gain[i] = -1, -1, -1.0   # Spark merges leaves that say the same
        else:
            size[i] = 1 + size[a] + size[a + 1]
    number = np.full(len(left), -1)
    number[0] = 0
    for i in np.flatnonzero(left >= 0):
        if number[i] >= 0:
            number[left[i]], number[left[i] + 1] = number[i] + 1, number[i] + 1 + size[left[i]]
    keep = np.flatnonzero(number >= 0)
    inner = left[keep] >= 0
    child = lambda k: np.where(inner, number[np.where(inner, left[keep] + k, 0)], -1)
    return pd.DataFrame({
        "tree": tree, "id": number[keep], "prediction": prediction[keep], "impurity": impurity[keep],
        "stats": list(total[keep, :-1]), "raw": np.rint(total[keep, -1]).astype(np.int64), "gain": gain[keep],
        "l": child(0), "r": child(1), "feature": feature[keep],
        "cut": [cuts[f][b] if f >= 0 else 0.0 for f, b in zip(feature[keep], cut[keep])]})
