"""Column-level helpers. Everything here returns a ``Column`` so it stays
inside whole-stage codegen; no Python runs per row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Dtype-driven numeric column set, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


def clean_double(c: str | Column) -> Column:
    """NaN -> NULL and -0.0 -> 0.0 (trap: Spark orders NaN above every number).

    Adding 0.0 maps -0.0 to +0.0 and leaves every other value unchanged.
    """
    x = col_(c).cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x + F.lit(0.0))


def safe_div(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    """Division that yields ``zero`` (0 = sklearn's zero_division=0) instead of
    raising under ANSI mode or returning NULL."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return q if zero is None else F.coalesce(q, F.lit(float(zero)))


def hash_order(key, seed: int) -> Column:
    """Portable pseudo-random order key: md5 of ``key:seed`` as lowercase hex.

    It depends on the key only, never on partitioning or file order, and the
    same expression in DuckDB gives the same order. A composite key (a list
    of columns) is joined with an unprintable separator first; a NULL key
    counts as the character U+0000, so its row has a place in the order too.
    """
    if isinstance(key, (list, tuple)):
        k = F.concat_ws("\u0001", *[F.coalesce(col_(c).cast("string"), F.lit("\u0000")) for c in key])
    else:
        k = F.coalesce(col_(key).cast("string"), F.lit("\u0000"))
    return F.md5(F.concat(k, F.lit(f":{seed}")))


def hex_bucket(hex_col: Column, digits: int) -> Column:
    """Monotone bucket from the leading hex digits of a hash (uniform load)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("long")


def any_true(conds: list[Column]) -> Column:
    """Row-wise ``any`` that treats NULL as False (trap T-1)."""
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def student_t_two_sided_p(t: Column, dof: int) -> Column:
    """Two-sided p-value of Student's t for an integer ``dof`` in closed form.

    Finite trigonometric series for integer degrees of freedom (Abramowitz &
    Stegun 26.7.3 / 26.7.4), built as plain column arithmetic.
    """
    if dof < 1:
        return F.lit(None).cast("double")
    theta = F.atan(F.abs(t) / F.lit(math.sqrt(dof)))
    c2 = F.pow(F.cos(theta), 2)
    s = F.sin(theta)
    if dof % 2 == 1:
        series = F.lit(0.0)
        if dof > 1:
            series, coef, power = F.lit(1.0), 1.0, F.lit(1.0)
            for j in range(1, (dof - 1) // 2):
                coef *= (2.0 * j) / (2.0 * j + 1.0)
                power = power * c2
                series = series + F.lit(coef) * power
            series = s * F.cos(theta) * series
        a = F.lit(2.0 / math.pi) * (theta + series)
    else:
        series, coef, power = F.lit(1.0), 1.0, F.lit(1.0)
        for j in range(1, dof // 2):
            coef *= (2.0 * j - 1.0) / (2.0 * j)
            power = power * c2
            series = series + F.lit(coef) * power
        a = s * series
    return F.when(t.isNull(), F.lit(None).cast("double")).otherwise(F.lit(1.0) - a)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engine-independent comparison, trap T-7)."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def pairwise_corr(a: str, b: str) -> Column:
    """Pearson r over rows where both are non-NULL; NULL for a constant column.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode on a constant column, so the
    ratio is built from ``covar_pop`` and pairwise-complete ``stddev_pop``.
    All three are algebraic aggregates (partial aggregation, any scale).
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    if a == b:  # the diagonal is exactly 1 (NULL when constant), as in pandas
        return F.when(F.stddev_pop(x) > 0, F.lit(1.0))
    xa = F.when(y.isNotNull(), x)
    yb = F.when(x.isNotNull(), y)
    den = F.stddev_pop(xa) * F.stddev_pop(yb)
    return F.try_divide(F.covar_pop(x, y), F.when(den != 0, den))
