"""Numeric column helpers. Missing is null inside the library; NaN and infinities are
turned into null (or a fill value) at the edges only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = "1e-12D"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value when finite, else null."""
    c = as_col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def finite_or(c: Column | str, fill: float = 0.0) -> Column:
    return F.coalesce(finite(c), F.lit(fill))


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(as_col(a), as_col(b))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp to a band; null stays null (least/greatest alone would drop the null)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def lenient_double(c: Column | str) -> Column:
    """Text to double: commas and percent signs are ignored, anything unreadable is 0."""
    text = F.regexp_replace(F.trim(as_col(c).cast("string")), "[,%]", "")
    return finite_or(text.try_cast("double"), 0.0)


def sigmoid(c: Column | str) -> Column:
    c = as_col(c)
    z = F.exp(-F.abs(c))
    return F.when(c >= 0, 1 / (1 + z)).otherwise(z / (1 + z))


def cashflow_ratio(ocf: Column | str, eps: Column | str, band: float = 10.0) -> Column:
    """Operating cash flow over earnings per share, zero earnings are missing."""
    return clip(ratio(ocf, zero_to_null(eps)), -band, band)


def half_up(c: Column | str, digits: int) -> Column:
    """Rounded value without negative zero."""
    r = F.round(as_col(c), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
