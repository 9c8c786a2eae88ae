import pytest
from pyspark.sql import functions as F

from trellis.operators import split
from trellis.session import cut_lineage


def _df(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("k"),
                                 F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("y"))


def test_stratified_split_exact_counts_and_partition_invariant(spark):
    df = _df(spark)
    a = split.stratified_split(df, "k", "y")
    counts = {(r.y, r.split): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert counts[(1, "test")] == 40 and counts[(0, "test")] == 160
    b = split.stratified_split(df.repartition(37), "k", "y")
    assert a.join(b, ["k", "split"]).count() == 1000


def test_random_split_exact_size(spark):
    df = _df(spark, 999)
    out = split.random_split(df, "k", 0.2)
    assert out.where(F.col("split") == "test").count() == 200


def test_folds_balanced(spark):
    df = _df(spark)
    f = split.stratified_kfold(df, "k", "y", k=5)
    per = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert set(per[(1, i)] for i in range(5)) == {40}
    g = split.kfold(df, "k", k=3)
    assert sorted(r["count"] for r in g.groupBy("fold").count().collect()) == [333, 333, 334]


@pytest.mark.parametrize("digits,rows", [(3, 1000), (1, 5), (2, 1)])
def test_learning_subsets_are_training_prefixes_in_hash_order(spark, monkeypatch, digits, rows):
    import hashlib
    monkeypatch.setattr(split, "CUT_DIGITS", digits)
    monkeypatch.setattr(split, "CUT_ROWS", rows)      # small ones are refined several times
    f = cut_lineage(split.stratified_kfold(_df(spark, 300), "k", "y", k=3), "folds")
    pdf = f.toPandas()
    pdf["h"] = [hashlib.md5(f"{k}:42".encode()).hexdigest() for k in pdf.k]
    cuts = split.learning_cuts(f, "k", 3)
    assert len(cuts) == 15
    for (fold, j), (size, last) in cuts.items():
        train = pdf[pdf.fold != fold].sort_values("h")
        assert size == split.learning_sizes(len(train))[j] and train.h.iloc[size - 1] == last
        if j in (0, 3):
            assert sorted(r.k for r in split.learning_subset(f, "k", fold, last).collect()) == sorted(train.k[:size])


def test_learning_subsets_with_a_repeated_key_and_without_rows(spark):
    df = spark.range(400).select(F.when(F.col("id") < 200, "same").otherwise(F.col("id").cast("string")).alias("k"),
                                 (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("fold"))
    counts = split.learning_subset_counts(df, "k", "y", 4).collect()
    assert len(counts) == 20 and all(r.n_rows >= r.train_size for r in counts)
    assert split.learning_subset_counts(df.where("false"), "k", "y", 4).count() == 0


def test_composite_key_split(spark):
    df = spark.range(600).select((F.col("id") % 20).alias("a"), (F.col("id") / 20).cast("int").alias("b"),
                                 (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = split.stratified_split(df, ["a", "b"], "y")
    assert out.where(F.col("split") == "test").count() == 120


from trellis.operators import profile


@pytest.mark.parametrize("n0,n1,train0,test0,train1,test1,diff", [
    (1175, 184, 940, 235, 147, 37, 0.08),
    (3136, 825, 2508, 628, 660, 165, 0.03),
    (4311, 1009, 3449, 862, 807, 202, 0.02),
])
def test_split_reproduces_reference_tables(spark, n0, n1, train0, test0, train1, test1, diff):
    df = spark.range(n0 + n1).select(F.col("id").alias("k"), (F.col("id") >= n0).cast("int").alias("y"))
    sp = split.stratified_split(df, "k", "y")
    chk = {r["class"]: r for r in profile.split_verification(sp, "y").collect()}
    assert (chk[0].train_n, chk[0].test_n, chk[1].train_n, chk[1].test_n) == (train0, test0, train1, test1)
    assert round(chk[0].diff_pp, 2) == diff and round(chk[1].diff_pp, 2) == diff
    assert chk[0].within_tol and chk[1].within_tol


def test_assert_unique_key(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    with pytest.raises(ValueError):
        split.assert_unique_key(df, "k")
    split.assert_unique_key(df.distinct(), "k")


def test_repeated_keys_rank_deterministically(spark):
    rows = [(i % 50, float(i)) for i in range(400)]   # keys repeat 8 times
    df = spark.createDataFrame(rows, "k int, v double")
    a = {(r.k, r.v): r.split for r in split.random_split(df, "k").collect()}
    b = {(r.k, r.v): r.split for r in split.random_split(df.repartition(13), "k").collect()}
    assert a == b and sum(s == "test" for s in a.values()) == 80


def test_split_with_map_column(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"),
                                F.create_map(F.lit("a"), F.col("id")).alias("m"))
    assert split.stratified_split(df, "k", "y").where("split = 'test'").count() == 10


def test_splits_and_folds_keep_rows_with_nulls(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), F.col("id"),
                                  F.when(F.col("id") % 7 != 0, (F.col("id") % 5 == 0).cast("int")).alias("y"))
    sp = split.stratified_split(df, "k", "y")
    assert sp.count() == 2000 and sp.where("split = 'test'").count() == 400
    assert split.random_split(df, "k").where("split = 'test'").count() == 400
    folds = split.stratified_kfold(df, "k", "y", k=4).groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in folds) == 2000 and len(folds) == 12
    for y in (0, 1, None):
        sizes = [r["count"] for r in folds if r.y == y]
        assert max(sizes) - min(sizes) <= 1
    assert split.kfold(df, "k", k=3).groupBy("fold").count().count() == 3


def test_quotas_with_a_null_class():
    q = split.stratum_quotas({0: 3, 1: 3, None: 3}, 0.5)
    assert sum(q.values()) == 5 and q[0] == 2 and q[1] == 2 and q[None] == 1
