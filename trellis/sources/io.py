"""Sources and sinks."""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Fixed values of the reference workflow.
CANDIDATE_DELIMITERS = (",", ";", "\t", "|")

BUNDLE_DESCRIPTION = "fitted preprocessing and model, ready to score raw rows"
#: column that carries the text of a rejected line
REJECTED = "_rejected_line"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet table ``root/name.parquet`` (column pruning and filter pushdown
    reach the scan)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def sniff_delimiter(header_line: str, candidates: Sequence[str] = CANDIDATE_DELIMITERS) -> str:
    """Pick the delimiter that splits the header into the most fields."""
    best, best_n = ",", 1
    for d in candidates:
        n = len(header_line.split(d))
        if n > best_n:
            best, best_n = d, n
    return best


def header_line(spark: SparkSession, path: str) -> str:
    """First line of the source (a one-row read); a missing file raises ``AnalysisException``."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0] if first else ""


def header_schema(line: str, sep: str, text: Sequence[str] = (), whole: Sequence[str] = ()) -> StructType:
    """Typed columns from a header line alone: ``text`` columns are strings, ``whole`` ones integers, all
    others doubles. No data is read to guess types."""
    names = [c.strip().strip('"') for c in line.split(sep)]
    kind = lambda c: StringType() if c in text else IntegerType() if c in whole else DoubleType()
    return StructType([StructField(c, kind(c)) for c in names])


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str | None = None,
             text: Sequence[str] = (), whole: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)`` of a CSV with header, typed from the start.

    The delimiter is sniffed from the header line unless given, the schema comes from the caller or
    from the header (``header_schema``); the data is read once, without an inference pass. Lines
    that do not fit the schema (a word in a number column, missing or surplus fields) are not in
    ``rows`` but in ``rejected``, one row a line with its text, so none is lost or turned into NULLs.
    A schema whose names differ from the header's raises ``ValueError``, a missing file
    ``AnalysisException``.
    """
    line = header_line(spark, path)
    sep = sep or sniff_delimiter(line)
    if schema is None:
        schema = header_schema(line, sep, text, whole)
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    found = [c.strip().strip('"') for c in line.split(sep)]
    if line and found != schema.names:
        raise ValueError(f"the header has {found}, the schema {schema.names}")
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", `{REJECTED}` string"
    parsed = F.from_csv("value", typed, {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED})
    every = spark.read.text(path).where((F.col("value") != F.lit(line)) & (F.trim("value") != "")).select(parsed.alias("r"))
    bad = F.col(f"r.{REJECTED}").isNotNull()
    rows = every.where(~bad).select(*[F.col(f"r.`{c}`").alias(c) for c in schema.names])
    return rows, every.where(bad).select(F.col(f"r.{REJECTED}").alias("line"))


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             sep: str | None = None, infer: bool = False) -> DataFrame:
    """CSV scan with header (S1/S2). With ``sep=None`` the delimiter is sniffed
    from the first line only (a one-row read), never from the data. Without a
    schema, columns are strings unless ``infer`` asks for an inference pass.

    A missing file raises ``AnalysisException`` at once (S3); malformed rows
    fail the job (``FAILFAST``) instead of turning silently into NULLs
    (``scan_csv`` keeps them apart instead).
    """
    if sep is None:
        sep = sniff_delimiter(header_line(spark, path))
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        # one extra pass over the file; jobs should pass an explicit schema
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False) -> None:
    """Report sink (S5): parquet by default, CSV with header on request.
    ``single_file`` is only for small report tables."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_text_report(sections: dict[str, DataFrame], path: str) -> None:
    """Text report (S6): each small table rendered as lines of one ``value``
    column, then written as text. Only report-sized tables belong here."""
    spark = next(iter(sections.values())).sparkSession
    lines = []
    for title, df in sections.items():
        lines.append(f"== {title} ==")
        cols = df.columns
        lines.append(" | ".join(cols))
        for r in df.collect():
            lines.append(" | ".join("" if r[c] is None else str(r[c]) for c in cols))
        lines.append("")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def save_model(model, path: str) -> None:
    """Model sink (S7): Spark ML persistence, preprocessing included when the
    model is a ``PipelineModel``."""
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def _preprocessing(model) -> dict[str, str]:
    """Which fitted preprocessing the stages of a pipeline carry (see ``operators.transform``)."""
    sql = [s.getStatement() for s in getattr(model, "stages", []) if hasattr(s, "getStatement")]
    held = {"imputer": any("coalesce(CAST(" in x for x in sql), "scaler": any(") / CAST(" in x for x in sql)}
    return {k: "included_in_pipeline" if v else "none" for k, v in held.items()}


def save_bundle(spark: SparkSession, model, path: str, description: str = BUNDLE_DESCRIPTION,
                extra: dict | None = None) -> None:
    """Production bundle (S8): the fitted pipeline plus a one-row metadata table
    with the creation time (ISO), a description, and whether the pipeline holds
    an imputer and a scaler (read from its stages)."""
    save_model(model, f"{path}/model")
    meta = {"created": _dt.datetime.now().isoformat(), "description": description, **_preprocessing(model)}
    if extra:
        meta.update({k: json.dumps(v) if not isinstance(v, str) else v for k, v in extra.items()})
    cols = sorted(meta)
    spark.createDataFrame([tuple(meta[c] for c in cols)], ", ".join(f"{c} string" for c in cols)) \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str):
    return load_pipeline(f"{path}/model"), spark.read.parquet(f"{path}/metadata").first().asDict()
