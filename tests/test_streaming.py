import tempfile

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from trellis.operators import models
from trellis.streaming.scoring import read_stream, score_stream


def test_stream_scoring_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="trellis-stream-")
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"),
                                 ((F.col("id") % 17) > 8).cast("int").alias("label"))
    df.write.mode("overwrite").parquet(f"{folder}/in")
    model = Pipeline(stages=[models.assembler(["a", "b"]), models.logistic_regression(400.0)]).fit(df)
    stream = read_stream(spark, f"{folder}/in", df.schema)
    q = (score_stream(stream, model, ["k"], threshold=0.5).writeStream.format("memory")
         .queryName("scored_stream").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r.k: r.prediction for r in spark.sql("SELECT * FROM scored_stream").collect()}
    batch = model.transform(df).select("k", "probability").collect()
    want = {r.k: int(r.probability[1] >= 0.5) for r in batch}
    assert got == want


def test_stream_to_parquet_sink_with_checkpoint(spark):
    from trellis.streaming.scoring import start
    folder = tempfile.mkdtemp(prefix="trellis-stream-")
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"),
                                 ((F.col("id") % 7) > 3).cast("int").alias("label"))
    df.write.mode("overwrite").parquet(f"{folder}/in")
    model = Pipeline(stages=[models.assembler(["a"]), models.logistic_regression(100.0)]).fit(df)
    q = start(score_stream(read_stream(spark, f"{folder}/in", df.schema), model, ["k"]),
              f"{folder}/out", f"{folder}/ckpt")
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == 100 and set(out.columns) == {"k", "p1", "prediction"}
