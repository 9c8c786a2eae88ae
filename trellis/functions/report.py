"""Report layer: formatted strings for humans, built from numeric columns.

Operators return numbers; these helpers only render them. Spark's
``format_string`` rounds HALF_UP on the decimal value (0.25 -> "0.3"), where
Python's f-strings round the binary value half-even, so a tie can render
differently -- compare numbers, never these strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pct(c: str | Column, digits: int = 1) -> Column:
    """``53.5%`` from a percentage value."""
    return F.format_string(f"%.{digits}f%%", F.col(c) if isinstance(c, str) else c)


def ratio(c: str | Column, digits: int = 1) -> Column:
    """``1:0.9`` imbalance ratio from ``neg / pos``."""
    return F.format_string(f"1:%.{digits}f", F.col(c) if isinstance(c, str) else c)


def at_least(c: str | Column) -> Column:
    """``>= 6`` threshold label."""
    return F.concat(F.lit(">= "), (F.col(c) if isinstance(c, str) else c).cast("string"))


# The column titles of the reference's printed tables (threshold_report, split_report).
THRESHOLD_TITLES = ("Threshold", "Good (1)", "Bad/Avg (0)", "Good %", "Imbalance Ratio")
SPLIT_TITLES = ("class", "Train Count", "Train %", "Test Count", "Test %")


def threshold_report(sensitivity: DataFrame) -> DataFrame:
    """The threshold table as the reference prints it."""
    cols = (at_least("threshold"), F.col("n_pos"), F.col("n_neg"), pct("pos_pct"), ratio("neg_per_pos"))
    return sensitivity.select(*[c.alias(t) for c, t in zip(cols, THRESHOLD_TITLES)])


def split_report(check: DataFrame) -> DataFrame:
    """The split verification table with formatted shares."""
    cols = (F.col("class"), F.col("train_n"), pct("train_pct", 2), F.col("test_n"), pct("test_pct", 2))
    return check.select(*[c.alias(t) for c, t in zip(cols, SPLIT_TITLES)],
                        F.format_string("%.2f", F.col("diff_pp")).alias("Diff (pp)"), "within_tol")
