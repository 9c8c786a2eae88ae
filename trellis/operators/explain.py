"""Per-row feature attributions.

* Linear models: ``phi_i = w_i * (x_i - mean_i)`` with the background mean of
  the data -- exact SHAP values for a linear model with independent features;
  pure column arithmetic.
* Tree ensembles: the fitted trees (a table with one row per node) are
  unfolded into a table of leaf paths, which passes over the rows take block by
  block; every partition adds the exact path-dependent TreeSHAP of the pass's
  leaves to its rows with numpy inside ``mapInPandas``.

The result is always the long table ``(key..., feature, value, phi)`` so the
global summary is a ``groupBy(feature)`` and a local explanation a filter.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference workflow.
LOCAL_MAX_DISPLAY = 12


def linear_attributions(df: DataFrame, keys: Sequence[str], coefficients: Mapping[str, float],
                        background: DataFrame | None = None) -> DataFrame:
    """Long ``(keys..., feature, value, phi)`` for a linear score."""
    bg = background if background is not None else df
    feats = list(coefficients)
    means = bg.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in feats]).first()
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                      (F.lit(float(coefficients[c])) * (F.col(c).cast("double") - F.lit(means[c])))
                      .alias("phi")) for c in feats]
    return df.select(*keys, F.explode(F.array(*items)).alias("a")).select(*keys, "a.*")


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature (the SHAP bar chart data)."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def local_explanation(attributions: DataFrame, max_display: int = LOCAL_MAX_DISPLAY,
                      keys: Sequence[str] = ()) -> DataFrame:
    """All features of each row by |phi| if there are at most ``max_display``, else
    the top ``max_display - 1`` and one ``other`` line that sums the rest (waterfall
    data, M11). Rows are independent, so the window is partitioned by the row key."""
    if not keys:
        raise ValueError("local_explanation needs the row key columns (the window is per row)")
    w = Window.partitionBy(*keys).orderBy(F.abs("phi").desc(), F.col("feature"))
    ranked = attributions.withColumn("rank", F.row_number().over(w))
    ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    shown = (F.col("_n") <= max_display) | (F.col("rank") < max_display)
    top = ranked.where(shown).drop("_n")
    rest = ranked.where(~shown).groupBy(*keys).agg(
        F.lit("other").alias("feature"), F.lit(None).cast("double").alias("value"),
        F.sum("phi").alias("phi"), F.lit(max_display).alias("rank"))
    return top.unionByName(rest.select(*keys, "feature", "value", "phi", F.col("rank").cast("int")),
                           allowMissingColumns=False)


# --------------------------------------------------------------------------- tree ensembles

#: leaves packed in one row, and bytes of leaf paths that one pass over the rows broadcasts
BLOCK_LEAVES, PASS_BYTES = 4_096, 64 << 20

LEAF_BLOCK = "tree int, block int, m int, bytes long, base double, v binary, f binary, lo binary, hi binary, z binary"


def _model_nodes(model, spark) -> DataFrame:
    """Node table of a fitted tree ensemble via Spark ML persistence: the model is written to the
    shared checkpoint folder and its ``data`` parquet (one row per node) is read back."""
    import uuid

    from trellis.session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories")


def leaf_blocks(model, spark) -> tuple[DataFrame, str]:
    """``(blocks, kind)``: the leaf paths of a Spark tree ensemble as a written table, ``BLOCK_LEAVES`` leaves
    with equally many path features a row.

    A leaf has a value and one entry per distinct feature on its path: the interval ``lo < x <= hi``
    and the product ``z`` of cover fractions. Trees are unfolded apart, by the executors. ``v`` already
    carries the tree weight, so the model output is the sum of reached leaf values:

    * boosted classifier: margin ``F`` (``p = 1 / (1 + exp(-2F))``);
    * random-forest classifier: probability of class 1 (mean over trees);
    * forest / boosted regressor: the prediction.
    """
    from trellis.session import cut_lineage
    name, weights = type(model).__name__, list(model.treeWeights)
    boosted, classifier = name.startswith("GBT"), "Classification" in name
    kind = "margin" if boosted and classifier else ("probability" if classifier else "prediction")
    unfold = _unfolder([w if boosted else 1.0 / len(weights) for w in weights], classifier and not boosted)
    nodes = _model_nodes(model, spark)
    return cut_lineage(nodes.groupBy("tree").applyInPandas(unfold, LEAF_BLOCK), "leaf-blocks"), kind


def _unfolder(weights: list[float], by_class: bool):
    import numpy as np
    import pandas as pd

    def unfold(nodes: "pd.DataFrame") -> "pd.DataFrame":
        tree = int(nodes["tree"].iloc[0])
        nodes = nodes.set_index("id")
        if (nodes["numCategories"].fillna(-1) > 0).any():
            raise ValueError("categorical splits are not supported by tree attributions")
        left, right = nodes["leftChild"].to_dict(), nodes["rightChild"].to_dict()
        stats = nodes["impurityStats"].to_dict()
        cover = {i: float(sum(st)) if by_class else float(st[0]) for i, st in stats.items()}
        split = {i: (int(f), float(t[0])) for i, f, t in zip(nodes.index, nodes["featureIndex"], nodes["leftCategoriesOrThreshold"])
                 if left[i] >= 0}
        if by_class:
            value = {i: (st[1] / cover[i] if cover[i] > 0 and len(st) > 1 else 0.0) for i, st in stats.items()}
        else:
            value = nodes["prediction"].to_dict()
        leaves: dict[int, list] = {}
        stack = [(0, {})]
        while stack:
            i, path = stack.pop()
            if left[i] < 0:
                leaves.setdefault(len(path), []).append((weights[tree] * value[i], [(f, *c) for f, c in path.items()]))
                continue
            f, cut = split[i]
            lo, hi, z = path.get(f, (-math.inf, math.inf, 1.0))
            for child, interval in ((left[i], (lo, min(hi, cut))), (right[i], (max(lo, cut), hi))):
                share = cover[child] / cover[i] if cover[i] > 0 else 0.0
                stack.append((child, {**path, f: (*interval, z * share)}))
        out = []
        for m, items in sorted(leaves.items()):
            for s in range(0, len(items), BLOCK_LEAVES):
                part = items[s:s + BLOCK_LEAVES]
                v = np.array([p[0] for p in part])
                cols = np.array([[list(c) for c in p[1]] for p in part], float).reshape(len(part), m, 4)
                base = float((v * cols[:, :, 3].prod(axis=1)).sum())
                out.append((tree, len(out), m, 8 * len(part) * (1 + 4 * m), base, v.tobytes(),
                            *[np.ascontiguousarray(cols[:, :, k]).tobytes() for k in range(4)]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEAF_BLOCK.split(", ")])
    return unfold


def _unpacked(rows) -> list:
    """Blocks as the arrays ``shap_values_numpy`` takes."""
    import numpy as np
    out = []
    for r in rows:
        v = np.frombuffer(r["v"])
        f, lo, hi, z = (np.frombuffer(r[c]).reshape(len(v), r["m"]) for c in ("f", "lo", "hi", "z"))
        out.append((r["m"], v, f.astype(np.int64), lo, hi, z))
    return out


def shap_values_numpy(X, packed, n_features: int, leaf_chunk: int = 256, row_chunk: int = 1024):
    """Row-chunked driver of ``_shap_block`` (bounded worker memory: about
    row_chunk x leaf_chunk x depth doubles per temporary)."""
    import numpy as np
    phi = np.zeros((X.shape[0], n_features))
    base = 0.0
    for a in range(0, max(X.shape[0], 1), row_chunk):
        part, base = _shap_block(X[a:a + row_chunk], packed, n_features, leaf_chunk)
        phi[a:a + row_chunk] = part
    return phi, base


def _shap_block(X, packed, n_features: int, leaf_chunk: int = 256):
    """Exact path-dependent TreeSHAP for a block of rows (leaf-path form).

    Per leaf with distinct path features F (|F| = m), one-fractions o_j (the
    row satisfies every split on feature j) and zero-fractions z_j (product of
    cover ratios): ``phi_i += v (o_i - z_i) sum_S w(|S|, m) prod_{S} o_j
    prod_{F minus S, i} z_j`` with Shapley weights ``w(s, m) = s!(m-s-1)!/m!``. The
    product polynomial ``prod_j (z_j + o_j t)`` is built once per leaf and
    divided by feature i's factor. Returns (phi [n x d], base value).
    """
    import numpy as np
    n = X.shape[0]
    phi = np.zeros((n, n_features))
    base = 0.0
    for m, v, f, lo, hi, z in packed:
        if m == 0:
            base += float(v.sum())
            continue
        base += float((v * z.prod(axis=1)).sum())
        w = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
        for a in range(0, len(v), leaf_chunk):
            vv, ff, ll, hh, zz = v[a:a + leaf_chunk], f[a:a + leaf_chunk], lo[a:a + leaf_chunk], \
                hi[a:a + leaf_chunk], z[a:a + leaf_chunk]
            L = len(vv)
            xv = X[:, ff]                                   # n x L x m
            o = ((xv > ll[None]) & (xv <= hh[None])).astype(float)
            zb = np.broadcast_to(zz[None], o.shape)
            poly = np.zeros((n, L, m + 1))
            poly[:, :, 0] = 1.0
            for j in range(m):                              # multiply by (z_j + o_j t)
                nxt = poly * zb[:, :, j:j + 1]
                nxt[:, :, 1:] += poly[:, :, :-1] * o[:, :, j:j + 1]
                poly = nxt
            for i in range(m):
                oi, zi = o[:, :, i], zb[:, :, i]
                # divide by (z_i + o_i t): o_i = 1 -> synthetic division, o_i = 0 -> / z_i
                q = np.zeros((n, L, m))
                q[:, :, m - 1] = poly[:, :, m]
                for s in range(m - 1, 0, -1):
                    q[:, :, s - 1] = poly[:, :, s] - zi * q[:, :, s]
                with np.errstate(divide="ignore", invalid="ignore"):
                    q0 = np.where(zi[..., None] > 0, poly[:, :, :m] / zi[..., None], 0.0)
                q = np.where(oi[..., None] > 0, q, q0)
                contrib = vv[None] * (oi - zi) * (q @ w)       # n x L
                onehot = np.zeros((L, n_features))
                onehot[np.arange(L), ff[:, i]] = 1.0
                phi += contrib @ onehot
    return phi, base


#: attributions that a task remembers
REMEMBERED = 200_000


class _IntervalShap:
    """Attributions of rows under the leaves of one pass. A tree sees only between which thresholds a value
    lies, so rows that agree in that for every feature share their attributions: they are computed
    once and remembered (up to ``REMEMBERED`` of them)."""

    def __init__(self, packed, n_features: int):
        import numpy as np
        self.packed, self.d = packed, n_features
        self.cuts = []
        for i in range(n_features):
            ends = [e[f == i] for _, _, f, lo, hi, _ in packed for e in (lo, hi)]
            ends = np.unique(np.concatenate(ends)) if ends else np.zeros(0)
            self.cuts.append(ends[np.isfinite(ends)])
        self.found: dict[bytes, int] = {}
        self.phi = np.zeros((0, n_features))

    def __call__(self, x):
        import numpy as np
        # a value that is no number lies in no interval: a place of its own
        place = np.stack([np.where(np.isnan(x[:, i]), -1, np.searchsorted(c, x[:, i], side="left"))
                          for i, c in enumerate(self.cuts)], 1).astype(np.int32)
        place = np.where(np.isneginf(x), -2, place).astype(np.int32)   # nor does minus infinity
        distinct, first, back = np.unique(place, axis=0, return_index=True, return_inverse=True)
        keys = [row.tobytes() for row in distinct]
        new = [i for i, k in enumerate(keys) if k not in self.found]
        if new and len(self.found) + len(new) > REMEMBERED:
            self.found, self.phi, new = {}, self.phi[:0], list(range(len(keys)))
        if new:
            fresh, _ = shap_values_numpy(x[first[new]], self.packed, self.d)
            self.found.update((keys[i], len(self.phi) + j) for j, i in enumerate(new))
            self.phi = np.concatenate([self.phi, fresh])
        return self.phi[[self.found[k] for k in keys]][back.reshape(-1)]


def _passes(sizes) -> list[list]:
    """Blocks in order, in groups of at most ``PASS_BYTES`` bytes (or one block)."""
    groups, size = [[]], 0
    for r in sizes:
        if groups[-1] and size + r["bytes"] > PASS_BYTES:
            groups.append([])
            size = 0
        groups[-1].append((r["tree"], r["block"]))
        size += r["bytes"]
    return [g for g in groups if g]


def tree_attributions(df: DataFrame, keys: Sequence[str], features: Sequence[str], model,
                      ) -> tuple[DataFrame, float, str]:
    """Exact TreeSHAP for every row of ``df``: long ``(keys..., feature, value, phi)``, plus the base value
    and the explained output (see ``leaf_blocks``).

    The leaf paths stay in a table. Each pass takes blocks of at most ``PASS_BYTES`` from it, broadcasts
    them and adds their share to every row's attributions, in Arrow batches and without a shuffle; the rows are
    written between passes. So neither the driver nor a worker holds more of the model than
    one pass, however large the forest."""
    import numpy as np
    import pandas as pd

    from trellis.session import cut_lineage
    spark, feats = df.sparkSession, list(features)
    blocks, kind = leaf_blocks(model, spark)
    sizes = blocks.select("tree", "block", "bytes").orderBy("tree", "block").collect()   # one short row a block
    base = float(blocks.agg(F.sum("base")).first()[0] or 0.0)
    rows = df.select(*keys, F.array(*[F.col(c).cast("double") for c in feats]).alias("_x"),
                     F.array(*[F.lit(0.0) for _ in feats]).alias("_phi"))

    def adds(shared):
        def run(batches):
            by_interval = _IntervalShap(shared.value, len(feats))
            for pdf in batches:
                x = np.array(pdf["_x"].tolist(), float).reshape(len(pdf), len(feats))
                phi = by_interval(x)
                old = np.array(pdf["_phi"].tolist(), float).reshape(phi.shape)
                yield pdf.assign(_phi=pd.Series(list(old + phi), dtype=object, index=pdf.index))
        return run

    groups = _passes(sizes)
    for i, group in enumerate(groups):
        (t0, b0), (t1, b1) = group[0], group[-1]
        place = F.struct("tree", "block")
        ends = [F.struct(F.lit(t).alias("tree"), F.lit(b).alias("block")) for t, b in ((t0, b0), (t1, b1))]
        shared = spark.sparkContext.broadcast(_unpacked(
            blocks.where((place >= ends[0]) & (place <= ends[1])).orderBy("tree", "block").collect()))
        rows = rows.mapInPandas(adds(shared), rows.schema)
        if i + 1 < len(groups):
            rows = cut_lineage(rows, "attributions")
    names = F.array(*[F.lit(c) for c in feats])
    long = rows.select(*keys, F.explode(F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"), F.col("_phi").alias("phi"))).alias("a"))
    return long.select(*keys, F.col("a.feature"), F.col("a.value"), F.col("a.phi")), base, kind
