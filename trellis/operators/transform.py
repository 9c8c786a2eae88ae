"""Leak-safe feature transformers fitted on the training part only.

Spark's ``Imputer(strategy='median')`` returns an element of the column
(2.0 for [1, 2, 3, 4]) and ``StandardScaler`` uses the sample deviation, so
both are re-expressed: the statistics come from one distributed aggregate on
the training rows, and the fitted transform is plain column arithmetic --
also available as a ``SQLTransformer`` stage, so it persists inside a
``PipelineModel`` with the model (S7).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.quantiles import exact_quantiles


def _q(name: str) -> str:
    return f"`{name}`"


@dataclass
class MedianImputerModel:
    medians: dict[str, float | None]
    suffix: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in self.medians.items():
            out = out.withColumn(c + self.suffix,
                                 F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")))
        return out

    def as_stage(self) -> SQLTransformer:
        sets = ", ".join(f"coalesce(CAST({_q(c)} AS DOUBLE), CAST({repr(float(m)) if m is not None else 'NULL'} AS DOUBLE)) AS {_q(c + self.suffix)}"
                         for c, m in self.medians.items())
        if not self.suffix:
            raise ValueError("as_stage needs a suffix: SQLTransformer cannot replace a column in place")
        return SQLTransformer(statement=f"SELECT *, {sets} FROM __THIS__")


def fit_median_imputer(train: DataFrame, cols: Sequence[str], suffix: str = "") -> MedianImputerModel:
    """Interpolated median per column on ``train``."""
    med = exact_quantiles(train, cols, [0.5])
    return MedianImputerModel({c: med[(c, 0.5)] for c in cols}, suffix)


@dataclass
class StandardScalerModel:
    stats: dict[str, tuple[float | None, float]]  # column -> (mean, scale)
    suffix: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, (mean, scale) in self.stats.items():
            out = out.withColumn(c + self.suffix,
                                 (F.col(c).cast("double") - F.lit(mean)) / F.lit(scale))
        return out

    def as_stage(self) -> SQLTransformer:
        if not self.suffix:
            raise ValueError("as_stage needs a suffix: SQLTransformer cannot replace a column in place")
        sets = ", ".join(
            f"(CAST({_q(c)} AS DOUBLE) - CAST({repr(float(m or 0.0))} AS DOUBLE)) / CAST({repr(float(s))} AS DOUBLE) AS {_q(c + self.suffix)}"
            for c, (m, s) in self.stats.items())
        return SQLTransformer(statement=f"SELECT *, {sets} FROM __THIS__")


def fit_standard_scaler(train: DataFrame, cols: Sequence[str], suffix: str = "") -> StandardScalerModel:
    """Mean and *population* standard deviation per column on ``train``; a
    constant column is divided by 1 (T2). One aggregate."""
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    stats = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        stats[c] = (row[f"m{i}"], 1.0 if not s else float(s))
    return StandardScalerModel(stats, suffix)
