"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import checkpoint_dir, forget, track  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` into the cluster's shared checkpoint folder (zstd parquet, with the writer's ``options``)
    and read it back. Lineage ends there: a lost executor costs re-reading."""
    spark = df.sparkSession
    path = track(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, per_task: int = 250_000) -> DataFrame:
    """``df`` in as many tasks as its counted ``rows`` need; never more than it has."""
    return df.coalesce(max(1, -(-rows // per_task)))


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only, so the result does not hang on Unicode tables."""
    return F.translate(c, UPPER, UPPER.lower())


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(mod))


def hash_sample(df: DataFrame, key: Column, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` rows of ``df`` (all, if it has no more), picked by a hash
    of ``key``: the same rows on every run and for every partitioning."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)) < bound)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast hint only for a side whose counted rows are at most ``most``;
    above it Spark plans a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def label_sample(labels: DataFrame, label: str, id_col: str, train: Column, bound: int) -> DataFrame:
    """``(id, label)`` of a bounded sample of the training rows. Rows without an
    id or a label are left out; a repeated id keeps its largest label."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")) \
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y")).where(train)
    return hash_sample(rows, F.col("_id"), bound)
