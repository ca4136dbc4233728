"""Black-76 prices and implied volatilities on numpy arrays, and their vectorised Spark functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberpanel.functions.distributions import normal_cdf

#: Bracket of implied volatility (fixed values).
LOW, HIGH = 1e-4, 5.0


def black76(forward, strike, years, rate, sigma, call):
    """Discounted Black-76 price; the discounted intrinsic value where sigma or time is not positive."""
    forward, strike, years, rate, sigma = (np.asarray(v, float) for v in (forward, strike, years, rate, sigma))
    sign = np.where(np.asarray(call, bool), 1.0, -1.0)
    discount = np.exp(-rate * years)
    live = (sigma > 0) & (years > 0)
    spread = np.where(live, sigma * np.sqrt(np.where(live, years, 1.0)), 1.0)
    d1 = np.log(forward / strike) / spread + spread / 2
    price = sign * (forward * normal_cdf(sign * d1) - strike * normal_cdf(sign * (d1 - spread)))
    return discount * np.where(live, price, np.maximum(sign * (forward - strike), 0.0))


def implied_vol(price, forward, strike, years, rate, call, steps: int = 60):
    """Volatility that gives ``price``, by bisection; NaN outside the no-arbitrage bounds or the bracket."""
    price, forward, strike, years, rate = (np.asarray(v, float) for v in np.broadcast_arrays(price, forward, strike, years, rate))
    call = np.broadcast_to(np.asarray(call, bool), price.shape)
    discount = np.exp(-rate * years)
    floor = discount * np.maximum(np.where(call, forward - strike, strike - forward), 0.0)
    ceiling = discount * np.where(call, forward, strike)
    with np.errstate(invalid="ignore"):
        good = (years > 0) & (price > floor + 1e-12) & (price < ceiling)
    low, high = np.full(price.shape, LOW), np.full(price.shape, HIGH)
    safe = [np.where(good, v, w) for v, w in ((forward, 1.0), (strike, 1.0), (years, 1.0), (rate, 0.0))]
    good &= (black76(*safe, low, call) <= price) & (black76(*safe, high, call) >= price)
    for _ in range(steps):
        middle = (low + high) / 2
        under = black76(*safe, middle, call) < price
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.where(good, (low + high) / 2, np.nan)


def _null(values) -> pd.Series:
    out = pd.Series(values, dtype="object")
    return out.where(out.notna() & np.isfinite(np.asarray(values, float)), None).astype("Float64")


def _price(forward: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, sigma: pd.Series, call: pd.Series) -> pd.Series:
    return pd.Series(black76(forward, strike, years, rate, sigma, call))


def _volatility(price: pd.Series, forward: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, call: pd.Series) -> pd.Series:
    return _null(implied_vol(price, forward, strike, years, rate, call.fillna(False).astype(bool)))


def black76_price(*columns: Column) -> Column:
    """Column of prices; arguments as of ``black76``."""
    return F.pandas_udf(_price, "double")(*columns)


def implied_volatility(*columns: Column) -> Column:
    """Column of implied volatilities, null where there is none; arguments as of ``implied_vol``."""
    return F.pandas_udf(_volatility, "double")(*columns)
