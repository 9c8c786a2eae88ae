import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.operators.rank import hash_rank, running_sums, with_next


def _data(spark, n=3000, parts=4):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.random(), rnd.randint(0, 5)) for i in range(n)]
    return spark.createDataFrame(rows, "k long, g string, x double, v long").repartition(parts)


def test_running_sums_equal_plain_window(spark):
    for parts in (1, 4, 37):
        df = _data(spark, parts=parts).withColumn("_b", (F.col("x") * 16).cast("int"))
        got = running_sums(df, [F.col("x"), F.col("k")], ["v"], "_b", ["g"])
        w = Window.partitionBy("g").orderBy("x", "k").rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumn("want", F.sum("v").over(w))
        j = got.join(want, "k").where(F.col("cum_v") != F.col("want"))
        assert j.count() == 0


def test_hash_rank_matches_row_number(spark):
    df = _data(spark, parts=5)
    got = hash_rank(df, "k", 42, ["g"], rank_col="r")
    w = Window.partitionBy("g").orderBy(F.md5(F.concat(F.col("k").cast("string"), F.lit(":42"))))
    want = df.withColumn("want", F.row_number().over(w))
    assert got.join(want, "k").where(F.col("r") != F.col("want")).count() == 0


def test_with_next_equals_lead(spark):
    df = _data(spark, n=800, parts=3).withColumn("_b", (F.col("x") * 7).cast("int"))
    got = with_next(df, [F.col("x"), F.col("k")], "_b", ["v"])
    w = Window.orderBy("x", "k")
    want = df.withColumn("want", F.lead("v").over(w))
    bad = got.join(want, "k").where(~F.col("next_v").eqNullSafe(F.col("want")))
    assert bad.count() == 0


def test_no_digit_count_loses_rows(spark):
    from trellis.functions.columns import hash_order
    from trellis.operators.rank import ORDER_HASH, bucket_offsets
    df = _data(spark, n=4000, parts=3)
    w = Window.partitionBy("g").orderBy(F.md5(F.concat(F.col("k").cast("string"), F.lit(":42"))))
    want = df.select("k", F.row_number().over(w).alias("want"))
    for digits in (3, 4, 5, 6, 7):
        offsets, used, per = bucket_offsets(df.withColumn(ORDER_HASH, hash_order("k", 42)), ["g"], digits=digits)
        assert used == digits and sum(per.values()) == 4000
        got = hash_rank(df, "k", 42, ["g"], digits=digits, rank_col="r", offsets=offsets)
        assert got.count() == 4000
        assert got.join(want, "k").where(F.col("r") != F.col("want")).count() == 0


def test_null_keys_and_partitions_keep_their_rows(spark):
    df = _data(spark, n=2000).select(F.when(F.col("k") % 10 != 0, F.col("k")).alias("k"),
                                     F.when(F.col("g") != "c", F.col("g")).alias("g"), "x")
    got = hash_rank(df, "k", 42, ["g"], rank_col="r")
    per = got.groupBy("g").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"),
                               F.countDistinct("r").alias("d")).collect()
    assert sum(r.n for r in per) == 2000 and len(per) == 3
    assert all((r.lo, r.hi, r.d) == (1, r.n, r.n) for r in per)
