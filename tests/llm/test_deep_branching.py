"""Pairs at the threshold in nodes that branch up to the last level."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import minhash_join


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_pairs_meet_at_any_depth(spark, monkeypatch, threshold):
    # two tokens a coordinate: unrelated documents halve at every level and reach the last one
    monkeypatch.setattr(minhash_join, "LEAF", 4)
    rng, pairs, trees = np.random.default_rng(3), 600, 3
    one = rng.integers(0, 2, (pairs, minhash_join.SKETCH)).astype(np.uint32)
    two = np.where(rng.random(one.shape) < threshold, one, 1 - one)
    rows = [(b"%04d%s" % (k, s), bytearray(x.tobytes())) for k in range(pairs) for s, x in ((b"a", one[k]), (b"b", two[k]))]
    vertices = spark.createDataFrame([(bytearray(v), sig) for v, sig in rows], "v binary, sig binary")
    leaf = minhash_join.leaves(vertices, trees).select("node", F.substring(F.col("v").cast("string"), 1, 4).alias("pair"))
    met = leaf.groupBy("node", "pair").count().where("count > 1").select("pair").distinct().count()
    assert met / pairs > 1 - minhash_join.miss_of(threshold, trees) - 0.03


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_trees_hold_the_stated_miss(threshold):
    assert minhash_join.miss_of(threshold, minhash_join.trees_for(threshold)) <= minhash_join.MISS
