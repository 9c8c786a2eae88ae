"""Corpus pipeline: documents to training sequences in five stages.

Each stage gets all rows that the one before it kept, calls one operator of
``trellis.llm`` and hands on the columns of ``documents``; the last returns pieces of
training sequences. Between stages the rows are written as Parquet to the cluster's
shared folder and read again, so the lineage of a stage ends there.

1. quality: documents that the classifier rejects go;
2. near duplicates (five-word shingles, similarity 0.8): one document of a group stays;
3. decontamination: documents with a benchmark passage go;
4. secrets: they are replaced in the texts, the documents stay;
5. packing: the rest is packed with the mixture of its sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import decontaminate, minhash_join, packing, quality_pu, secrets_crf
from trellis.llm.common import shared_table, table
from trellis.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_pu.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality_pu.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_join.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_crf.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", pack)]

#: No stage but the third can be said in SQL, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = shared_table(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
