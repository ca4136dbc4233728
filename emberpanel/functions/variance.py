"""Daily variance estimators and rolling volatility as column expressions over a (ticker, date) panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Column suffixes of the estimators, in the order of output (fixed values).
SUFFIXES = {"close_to_close": "cc", "parkinson": "parkinson", "garman_klass": "gk", "rogers_satchell": "rs", "intraday_rv": "intraday", "yang_zhang": "yz"}
DEFAULT_ESTIMATORS = ("close_to_close", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang")


def by_date(keys: tuple[str, ...] = ("ticker",), order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def log_ratio(a: str, b: str) -> Column:
    """ln a - ln b; null unless both are positive."""
    return F.ln(a) - F.ln(b)


def log_return(w: WindowSpec, price: str = "close") -> Column:
    return F.ln(price) - F.lag(F.ln(price)).over(w)


def close_to_close(w: WindowSpec) -> Column:
    return F.pow(log_return(w), F.lit(2.0))


def parkinson() -> Column:
    return F.pow(log_ratio("high", "low"), F.lit(2.0)) / (4 * math.log(2))


def garman_klass() -> Column:
    return F.pow(log_ratio("high", "low"), F.lit(2.0)) * 0.5 - F.pow(log_ratio("close", "open"), F.lit(2.0)) * (2 * math.log(2) - 1)


def rogers_satchell() -> Column:
    return log_ratio("high", "close") * log_ratio("high", "open") + log_ratio("low", "close") * log_ratio("low", "open")


def yang_zhang_weight(window: int) -> float:
    """Weight of the open-to-close part: 0.34 / (1.34 + (n + 1) / (n - 1))."""
    if window < 2:
        raise ValueError("window must be at least 2")
    return 0.34 / (1.34 + (window + 1) / (window - 1))


def overnight_return(w: WindowSpec) -> Column:
    return F.ln("open") - F.lag(F.ln("close")).over(w)


def yang_zhang(w: WindowSpec, window: int) -> Column:
    k = yang_zhang_weight(window)
    return F.pow(overnight_return(w), F.lit(2.0)) + F.pow(log_ratio("close", "open"), F.lit(2.0)) * k + rogers_satchell() * (1 - k)


def daily(name: str, w: WindowSpec, window: int) -> Column:
    """One day's variance by an estimator's name; ``intraday_rv`` must be a column of the panel."""
    if name == "intraday_rv":
        return F.col("intraday_rv")
    if name not in SUFFIXES:
        raise ValueError(f"unknown estimator {name!r}")
    return {"close_to_close": lambda: close_to_close(w), "parkinson": parkinson, "garman_klass": garman_klass, "rogers_satchell": rogers_satchell, "yang_zhang": lambda: yang_zhang(w, window)}[name]()


def full(aggregate: Column, value: Column, frame: WindowSpec, n: int) -> Column:
    """``aggregate`` over ``frame`` where it holds ``n`` values of ``value``, else null."""
    return F.when(F.count(value).over(frame) == n, aggregate.over(frame))


def rolling(w: WindowSpec, value: str, n: int, aggregate=F.avg) -> Column:
    return full(aggregate(value), F.col(value), w.rowsBetween(1 - n, 0), n)


def realized_vol(variance: Column, factor: float) -> Column:
    """Annualised volatility; null for a negative variance."""
    return F.when(variance >= 0, F.sqrt(variance * factor))


def estimate(panel, name: str, *, window: int = 21, factor: float = 252.0, keys: tuple[str, ...] = ("ticker",)):
    """Add var_<suffix> (one day), win_<suffix> (windowed) and rv_<suffix> (annualised) for one estimator.

    Windowed means need a full window of values. Close-to-close takes the sample variance of returns; Yang-Zhang combines sample
    variances of overnight and open-to-close returns with the mean of Rogers-Satchell.
    """
    w, s = by_date(keys), SUFFIXES[name]
    frame = w.rowsBetween(1 - window, 0)
    out = panel.withColumn(f"var_{s}", daily(name, w, window))
    if name == "close_to_close":
        out = out.withColumn("_r", log_return(w))
        win = full(F.var_samp("_r"), F.col("_r"), frame, window)
    elif name == "yang_zhang":
        k = yang_zhang_weight(window)
        out = out.withColumns({"_r": overnight_return(w), "_c": log_ratio("close", "open"), "_s": rogers_satchell()})
        win = full(F.var_samp("_r"), F.col("_r"), frame, window) + full(F.var_samp("_c"), F.col("_c"), frame, window) * k + full(F.avg("_s"), F.col("_s"), frame, window) * (1 - k)
    else:
        win = full(F.avg(f"var_{s}"), F.col(f"var_{s}"), frame, window)
    out = out.withColumn(f"win_{s}", win)
    return out.withColumn(f"rv_{s}", realized_vol(F.col(f"win_{s}"), factor)).drop("_r", "_c", "_s")


def intraday_variance(bars, *, price: str = "close", min_bars: int = 10):
    """(ticker, date, intraday_rv): squared log moves within a session, summed; null with fewer than ``min_bars`` positive prices."""
    good = bars.where(F.col(price) > 0).withColumn("date", F.to_date("ts"))
    w = Window.partitionBy("ticker", "date").orderBy("ts")
    move = good.withColumn("_m", F.pow(F.ln(price) - F.lag(F.ln(price)).over(w), F.lit(2.0)))
    total = move.groupBy("ticker", "date").agg(F.coalesce(F.sum("_m"), F.lit(0.0)).alias("_s"), F.count("*").alias("_n"))
    return total.select("ticker", "date", F.when(F.col("_n") >= min_bars, F.col("_s")).alias("intraday_rv"))


def with_intraday(panel, bars, **options):
    """The panel with the intraday variance of each of its sessions; null without bars."""
    if bars is None:
        return panel.withColumn("intraday_rv", F.lit(None).cast("double"))
    return panel.join(intraday_variance(bars, **options), ["ticker", "date"], "left")
