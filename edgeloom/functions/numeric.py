"""Numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def finite(col: Column, default: float | None = 0.0) -> Column:
    """NaN, infinities and nulls become ``default``."""
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(col)


def entropy_bits(counts: list[Column]) -> Column:
    """Shannon entropy in bits of a list of counts; 0 when they are all 0."""
    total = sum(counts[1:], counts[0])
    terms = []
    for c in counts:
        p = c / total
        terms.append(F.when(c > 0, -p * F.log2(p)).otherwise(F.lit(0.0)))
    return F.when(total > 0, sum(terms[1:], terms[0])).otherwise(F.lit(0.0))


def guarded_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate; null (never an error) on constant input."""
    cx = F.col(x) if isinstance(x, str) else x
    cy = F.col(y) if isinstance(y, str) else y
    both = cx.isNotNull() & cy.isNotNull()
    px = F.when(both, cx.cast("double"))
    py = F.when(both, cy.cast("double"))
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    constant = (F.max(px) == F.min(px)) | (F.max(py) == F.min(py))
    return F.when(~constant, F.covar_pop(px, py) / F.nullif(spread, F.lit(0.0)))


# Euler's constant for the harmonic-number expansion.
_EULER_GAMMA = 0.5772156649015329


def harmonic_number(n: Column) -> Column:
    """H(n), exact below 32 and by the asymptotic series (error < 1e-11) above."""
    d = n.cast("double")
    small = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.least(n.cast("int"), F.lit(32))), lambda i: i),
        F.lit(0.0),
        lambda acc, i: acc + F.when(i > 0, 1.0 / i).otherwise(0.0),
    )
    safe = F.greatest(d, F.lit(1.0))
    series = (
        F.log(safe)
        + F.lit(_EULER_GAMMA)
        + 1.0 / (2.0 * safe)
        - 1.0 / (12.0 * safe * safe)
        + 1.0 / (120.0 * safe * safe * safe * safe)
    )
    return F.when(n < 32, small).otherwise(series)


def parsed_float(col: Column) -> Column:
    """A number, or text that reads as one, as double; anything else null."""
    return col.try_cast("double")


def safe_float(df: DataFrame, name: str) -> Column:
    """A numeric column as double; text and booleans are no numbers, whatever they say."""
    kind = df.schema[name].dataType
    return F.col(name).cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def status_code(df: DataFrame, name: str, default: int = 1) -> Column:
    """Booleans, integers and text of digits as a code; all else, the text "true" too, ``default``."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        code = F.col(name).cast("long")
    elif isinstance(kind, T.StringType):
        text = F.trim(F.col(name))
        code = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    else:
        code = F.lit(None).cast("long")
    return F.coalesce(code, F.lit(default).cast("long"))
