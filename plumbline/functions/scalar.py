"""Scalar column functions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal numbers as text: optional sign, digits with an optional point, optional exponent.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    x = as_col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(c: Column | str) -> Column:
    """The number itself, or null for NaN and infinities."""
    x = as_col(c)
    return F.when(is_finite(x), x)


def to_double(c: Column | str) -> Column:
    """Text to double; null for anything that is not a plain decimal number."""
    x = as_col(c)
    return F.when(x.rlike(NUMBER_PATTERN), F.trim(x).try_cast("double"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(as_col(c), digits) + F.lit(0.0)
