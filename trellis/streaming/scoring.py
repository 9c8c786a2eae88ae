"""Scoring a stream with a fitted pipeline.

The reference only describes its models as usable for real-time
classification; with Spark ML a fitted ``PipelineModel`` (preprocessing
included, S7) applies unchanged to a streaming DataFrame. Rows are scored
independently, so there is no state and no watermark; the sink gets the
positive-class probability and the thresholded label (P7, P12).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def score_stream(stream: DataFrame, model: PipelineModel, keys: list[str],
                 threshold: float | None = None) -> DataFrame:
    """Streaming ``(keys..., p1, prediction)``. With ``threshold`` the label is
    ``p1 >= threshold`` (a tuned threshold), else the model's own prediction."""
    out = model.transform(stream)
    p1 = vector_to_array(F.col("probability"))[1] if "probability" in out.columns else F.lit(None).cast("double")
    out = out.select(*keys, p1.alias("p1"), F.col("prediction").cast("int").alias("prediction"))
    if threshold is not None:
        out = out.withColumn("prediction", F.when(F.col("p1") >= F.lit(threshold), 1).otherwise(0))
    return out


def start(scored: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
          trigger_seconds: int | None = None):
    """Append the scored rows to ``sink_path``; the query checkpoint lives in
    ``checkpoint`` (a shared folder, so a restarted driver resumes exactly)."""
    w = scored.writeStream.format(fmt).option("path", sink_path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
