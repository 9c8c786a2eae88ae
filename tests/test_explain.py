import math

import numpy as np
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trellis.operators.explain import (global_importance, linear_attributions, local_explanation,
                                       tree_attributions)


def _data(spark, n=300):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(n, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2]) > 0).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, label int")


def _fit(est, df):
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    return est.fit(v), v


def test_gbt_shap_sums_to_margin(spark):
    df = _data(spark)
    m, v = _fit(GBTClassifier(maxIter=5, maxDepth=3, seed=1), df)
    att, base, kind = tree_attributions(df, ["k"], ["a", "b", "c"], m)
    assert kind == "margin"
    tot = att.groupBy("k").agg(F.sum("phi").alias("s"))
    pred = m.transform(v).select("k", vector_to_array("probability")[1].alias("p"))
    j = tot.join(pred, "k").collect()
    for r in j:
        margin = 0.5 * math.log(r.p / (1 - r.p))
        assert math.isclose(base + r.s, margin, abs_tol=1e-9)


def test_rf_shap_sums_to_probability(spark):
    df = _data(spark)
    m, v = _fit(RandomForestClassifier(numTrees=4, maxDepth=4, seed=3), df)
    att, base, kind = tree_attributions(df, ["k"], ["a", "b", "c"], m)
    assert kind == "probability"
    tot = att.groupBy("k").agg(F.sum("phi").alias("s"))
    pred = m.transform(v).select("k", vector_to_array("probability")[1].alias("p"))
    for r in tot.join(pred, "k").collect():
        assert math.isclose(base + r.s, r.p, abs_tol=1e-9)


def test_single_split_tree_shap_closed_form(spark):
    # one split on a: phi_a = f(x) - E f, others 0
    df = _data(spark, 200)
    m, v = _fit(GBTClassifier(maxIter=1, maxDepth=1, seed=1), df)
    att, base, _ = tree_attributions(df, ["k"], ["a", "b", "c"], m)
    nz = att.where(F.abs("phi") > 1e-12).select("feature").distinct().collect()
    assert len(nz) <= 1


def test_linear_attributions_and_local_fold(spark):
    df = _data(spark, 50)
    att = linear_attributions(df, ["k"], {"a": 2.0, "b": -1.0, "c": 0.5})
    means = df.agg(F.avg("a"), F.avg("b"), F.avg("c")).first()
    r = att.where((F.col("k") == 3) & (F.col("feature") == "a")).first()
    x = df.where("k = 3").first()
    assert math.isclose(r.phi, 2.0 * (x.a - means[0]))
    loc = local_explanation(att.where("k = 3"), max_display=2, keys=["k"]).collect()
    assert len(loc) == 2 and any(x.feature == "other" for x in loc)
    g = global_importance(att).collect()
    assert len(g) == 3


def test_tree_shap_equals_brute_force_shapley(spark):
    from itertools import combinations

    from trellis.operators.explain import _unpacked, leaf_blocks, shap_values_numpy
    df = _data(spark, 200)
    m, _ = _fit(GBTClassifier(maxIter=3, maxDepth=3, seed=2), df)
    blocks, _ = leaf_blocks(m, spark)
    X = np.array([[r.a, r.b, r.c] for r in df.limit(20).collect()])
    packed = _unpacked(blocks.collect())
    leaves = [(v[i], list(zip(f[i], lo[i], hi[i], z[i]))) for _, v, f, lo, hi, z in packed for i in range(len(v))]
    phi, base = shap_values_numpy(X, packed, 3)

    def expect(x, S):
        tot = 0.0
        for v, conds in leaves:
            p = v
            for f, lo, hi, z in conds:
                p *= (1.0 if lo < x[f] <= hi else 0.0) if f in S else z
            tot += p
        return tot

    d = 3
    for r, x in enumerate(X):
        for i in range(d):
            others = [j for j in range(d) if j != i]
            val = 0.0
            for s in range(d):
                for S in combinations(others, s):
                    wgt = math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d)
                    val += wgt * (expect(x, set(S) | {i}) - expect(x, set(S)))
            assert math.isclose(phi[r, i], val, abs_tol=1e-10)
        assert math.isclose(base, expect(x, set()), abs_tol=1e-12)


def test_a_deep_forest_in_many_passes_over_its_leaf_blocks(spark, monkeypatch):
    from trellis.operators import explain
    df = _data(spark)
    m, v = _fit(RandomForestClassifier(numTrees=12, maxDepth=30, seed=3, featureSubsetStrategy="all"), df)
    whole, base, _ = tree_attributions(df, ["k"], ["a", "b", "c"], m)
    monkeypatch.setattr(explain, "PASS_BYTES", 4_000)
    monkeypatch.setattr(explain, "BLOCK_LEAVES", 16)
    blocks, _ = explain.leaf_blocks(m, spark)
    assert len(explain._passes(blocks.orderBy("tree", "block").collect())) > 3
    parts, base2, _ = tree_attributions(df, ["k"], ["a", "b", "c"], m)
    a, b = ({(r.k, r.feature): r.phi for r in x.collect()} for x in (whole, parts))
    assert a.keys() == b.keys() and all(math.isclose(a[x], b[x], abs_tol=1e-9) for x in a)
    assert math.isclose(base, base2, abs_tol=1e-9)
    p = {r.k: r.p for r in m.transform(v).select("k", vector_to_array("probability")[1].alias("p")).collect()}
    for k, want in p.items():
        assert math.isclose(base2 + sum(b[(k, f)] for f in "abc"), want, abs_tol=1e-9)


def test_equal_intervals_are_computed_once(monkeypatch):
    """Rows between the same thresholds share their attributions, which equal those computed row by row."""
    import numpy as np

    from trellis.operators import explain
    rng = np.random.default_rng(3)
    inf = np.inf
    packed = [(2, rng.normal(size=4), np.array([[0, 1]] * 4), np.array([[-inf, -inf], [-inf, 0.5], [0.3, -inf], [0.3, 0.2]]),
               np.array([[0.3, 0.5], [0.3, inf], [inf, 0.2], [inf, inf]]), rng.uniform(0.1, 0.9, (4, 2)))]
    x = rng.uniform(0, 1, (5000, 2))
    x[:40, 0], x[40:80, 1] = 0.3, 0.5
    x[80, 0], x[81, 1], x[82, 0], x[83, 1] = np.nan, np.nan, -inf, inf
    whole, _ = explain.shap_values_numpy(x, packed, 2)
    seen, plain = [], explain.shap_values_numpy
    monkeypatch.setattr(explain, "shap_values_numpy", lambda a, *r: seen.append(len(a)) or plain(a, *r))
    once = explain._IntervalShap(packed, 2)
    got = np.concatenate([once(x[a:a + 500]) for a in range(0, 5000, 500)])
    assert np.array_equal(got, whole) and sum(seen) < 20
    monkeypatch.setattr(explain, "REMEMBERED", 3)
    few = explain._IntervalShap(packed, 2)
    assert np.array_equal(np.concatenate([few(x[a:a + 500]) for a in range(0, 5000, 500)]), whole)
