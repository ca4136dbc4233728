"""Forecast losses as column expressions. A missing value is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def qlike(realized: Column, forecast: Column, variances: bool = False) -> Column:
    """r/f - ln(r/f) - 1 on variances; null unless both inputs are positive, judged before squaring."""
    r, f = known(realized), known(forecast)
    ratio = F.try_divide(r, f) if variances else F.pow(F.try_divide(r, f), F.lit(2.0))
    return F.when((r > 0) & (f > 0), ratio - F.ln(ratio) - 1)


def squared_error(realized: Column, forecast: Column) -> Column:
    return F.pow(known(realized) - known(forecast), F.lit(2.0))


def absolute_error(realized: Column, forecast: Column) -> Column:
    return F.abs(known(realized) - known(forecast))


LOSSES = {"qlike": qlike, "se": squared_error, "ae": absolute_error}
