"""The missing-value policy: na is NULL, never NaN; comparisons with na are false; truth of na, 0 and non-finite is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clean(x) -> Column:
    """NaN and infinities become NULL."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def is_na(x) -> Column:
    return col(x).isNull()


def nz(x, replacement=0.0) -> Column:
    return F.coalesce(col(x), col(replacement))


def truthy(x) -> Column:
    return F.coalesce(col(x).cast("boolean"), F.lit(False))


def not_(x) -> Column:
    return ~truthy(x)


def and_(a, b) -> Column:
    return truthy(a) & truthy(b)


def or_(a, b) -> Column:
    return truthy(a) | truthy(b)


def lt(a, b) -> Column:
    return F.coalesce(col(a) < col(b), F.lit(False))


def le(a, b) -> Column:
    return F.coalesce(col(a) <= col(b), F.lit(False))


def gt(a, b) -> Column:
    return F.coalesce(col(a) > col(b), F.lit(False))


def ge(a, b) -> Column:
    return F.coalesce(col(a) >= col(b), F.lit(False))


def _nine(x) -> Column:
    return F.round(col(x).cast("double") * 1e9)


def eq(a, b) -> Column:
    """Numbers are equal if they agree to nine fractional digits."""
    return F.coalesce(_nine(a) == _nine(b), F.lit(False))


def ne(a, b) -> Column:
    return F.coalesce(_nine(a) != _nine(b), F.lit(False))


def div(a, b) -> Column:
    """Quotient as double; NULL where the divisor is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def mod(a, b) -> Column:
    return F.try_mod(col(a), col(b))


def to_int(x) -> Column:
    """Towards zero."""
    x = col(x).cast("double")
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def to_float(x) -> Column:
    return col(x).cast("double")
