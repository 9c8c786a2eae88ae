import math

from pyspark.sql import functions as F

from trellis.operators import prep


def test_binary_label_nan_null_and_threshold(spark):
    df = spark.createDataFrame([(1, 7.0), (2, 6.9), (3, float("nan")), (4, None), (5, 10.0)],
                               "id int, quality double")
    out = {r.id: r.target for r in prep.binary_label(df).collect()}
    assert out == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}


def test_binary_label_kept_when_present(spark):
    df = spark.createDataFrame([(1, 9, 0)], "id int, quality int, target int")
    assert prep.binary_label(df).first().target == 0


def test_dedup_nan_and_negative_zero(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (float("nan"), -0.0), (1.0, 2.0), (1.0, 2.0)],
                               "a double, b double")
    assert prep.dedup(df).count() == 2
    s = prep.dedup_summary(df).first()
    assert (s.initial_rows, s.final_rows, s.removed) == (4, 2, 2)
    assert math.isclose(s.removed_pct, 50.0)


def test_clean_numeric(spark):
    df = spark.createDataFrame([(float("nan"),), (-0.0,), (3.0,)], "x double")
    vals = [r.x for r in prep.clean_numeric(df).collect()]
    assert vals[0] is None and math.copysign(1.0, vals[1]) == 1.0 and vals[2] == 3.0


def test_encode_unknown_to_null_and_numeric_untouched(spark):
    df = spark.createDataFrame([("red",), ("white",), ("rose",)], "type string")
    assert [r.type for r in prep.encode_category(df, "type").collect()] == [0, 1, None]
    num = spark.createDataFrame([(1,)], "type int")
    assert prep.encode_category(num, "type").first().type == 1


def test_drop_leaks_ignores_absent(spark):
    df = spark.createDataFrame([(1, 2)], "a int, quality int")
    assert prep.drop_leaks(df).columns == ["a"]


def test_union_dedups_each_source_before_marker(spark):
    a = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    b = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    out = prep.union_sources([a, b], marker="type", markers=[0, 1])
    assert sorted((r.x, r.type) for r in out.collect()) == [(1.0, 0), (1.0, 1), (2.0, 1)]


def test_fixed_sample_exact_size_and_partition_invariant(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r.k for r in prep.fixed_sample(df, "k", 100).collect()}
    b = {r.k for r in prep.fixed_sample(df.repartition(37), "k", 100).collect()}
    assert len(a) == 100 and a == b
    assert prep.fixed_sample(df.limit(10), "k", 100).count() == 10


def test_row_key_unique_after_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    keyed = prep.row_key(prep.dedup(df))
    assert keyed.select("row_key").distinct().count() == 2


def test_first_positive_fallback(spark):
    df = spark.createDataFrame([(3, 0), (1, 0), (2, 0)], "k int, prediction int")
    assert prep.first_positive(df, "k").first().k == 1
    df2 = df.union(spark.createDataFrame([(9, 1)], "k int, prediction int"))
    assert prep.first_positive(df2, "k").first().k == 9
