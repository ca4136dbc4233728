"""Option chains to constant-maturity implied volatility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.functions.options import implied_volatility
from emberpanel.operators.cleaning import mid_price

#: Log-moneyness of the quoted points (fixed values).
POINTS = {"atm": 0.0, "m90": math.log(0.9), "m110": math.log(1.1)}
TARGET_DAYS, MIN_DAYS, YEAR_SECONDS = 30.0, 7.0, 365.0 * 86400.0


def years_to_expiry(expiry: Column, asof: Column) -> Column:
    """Years of 365 days from ``asof`` (UTC) to 16:00 in New York on the expiry date."""
    close = F.to_utc_timestamp((expiry.cast("timestamp") + F.expr("INTERVAL 16 HOURS")), "America/New_York")
    return (F.unix_micros(close) - F.unix_micros(asof)) / 1e6 / YEAR_SECONDS


def implied_forwards(chain: DataFrame, keys: tuple[str, ...] = ("ticker", "asof", "expiry"), rate: float = 0.04) -> DataFrame:
    """(keys, forward): strike + e^(rT)(call - put) where call and put mids differ least, at the lowest strike on ties."""
    sided = chain.where("mid is not null").groupBy(*keys, "strike").agg(F.max("years").alias("years"), F.max(F.when(F.col("type") == "call", F.col("mid"))).alias("c"), F.max(F.when(F.col("type") == "put", F.col("mid"))).alias("p"))
    both = sided.where("c is not null and p is not null")
    at = F.min(F.struct(F.abs(F.col("c") - F.col("p")).alias("gap"), "strike", "c", "p", "years")).alias("m")
    return both.groupBy(*keys).agg(at).select(*keys, (F.col("m.strike") + F.exp(F.col("m.years") * rate) * (F.col("m.c") - F.col("m.p"))).alias("forward"))


def smiles(chain: DataFrame, spot: float, *, rate: float = 0.04, keys: tuple[str, ...] = ("ticker", "asof", "expiry")) -> DataFrame:
    """Out-of-the-money contracts with log-moneyness k and implied volatility iv.

    The forward is the parity forward, or spot grown at the rate without one. Calls count from the forward up, puts below.
    """
    live = chain.withColumn("mid", mid_price(F.col("bid"), F.col("ask")))
    if "years" not in chain.columns:
        live = live.withColumn("years", years_to_expiry(F.col("expiry"), F.col("asof")))
    live = live.where("years > 0")
    forward = implied_forwards(live, keys, rate)
    out = live.join(forward, list(keys), "left").withColumn("forward", F.coalesce("forward", F.lit(spot) * F.exp(F.col("years") * rate)))
    call = F.col("type") == "call"
    out = out.where((call & (F.col("strike") >= F.col("forward"))) | (~call & (F.col("strike") < F.col("forward"))))
    iv = implied_volatility(F.col("mid"), F.col("forward"), F.col("strike"), F.col("years"), F.lit(rate), call)
    return out.withColumn("k", F.ln(F.col("strike") / F.col("forward"))).withColumn("iv", iv)


def interpolate(points: DataFrame, at: dict[str, float], keys: tuple[str, ...], x: str = "k", y: str = "iv") -> DataFrame:
    """Linear interpolation of each key's known (x, y) at named places; null outside their range."""
    good = points.where(F.col(y).isNotNull() & ~F.isnan(y))
    found = []
    for name, k0 in at.items():
        low = F.max(F.when(F.col(x) <= k0, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias(f"_lo_{name}")
        high = F.min(F.when(F.col(x) >= k0, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias(f"_hi_{name}")
        found += [low, high]
    out = good.groupBy(*keys).agg(*found)
    for name, k0 in at.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        slope = F.try_divide(hi["y"] - lo["y"], hi["x"] - lo["x"])
        out = out.withColumn(name, F.when(lo["x"] == hi["x"], lo["y"]).otherwise(lo["y"] + slope * (F.lit(k0) - lo["x"])))
    return out.select(*keys, *at)


def constant_maturity(terms: DataFrame, value: str, keys: tuple[str, ...] = ("ticker", "asof"), *, target_days: float = TARGET_DAYS, min_days: float = MIN_DAYS) -> DataFrame:
    """(keys, iv, flag): volatility at the target maturity, linear in total variance between the expiries around it.

    Expiries (years, value) under ``min_days`` do not count. One-sided terms give the nearest expiry: near_only or far_only; none gives null.
    """
    target, least = target_days / 365.0, min_days / 365.0
    good = terms.where(F.col(value).isNotNull() & (F.col("years") >= least))
    point = F.struct(F.col("years").alias("t"), F.col(value).alias("v"))
    out = terms.select(*keys).distinct().join(good.groupBy(*keys).agg(F.max(F.when(F.col("years") <= target, point)).alias("n"), F.min(F.when(F.col("years") > target, point)).alias("f")), list(keys), "left")
    n, f = F.col("n"), F.col("f")
    near, far = F.pow(n["v"], F.lit(2.0)) * n["t"], F.pow(f["v"], F.lit(2.0)) * f["t"]
    total = near + (far - near) * (F.lit(target) - n["t"]) / (f["t"] - n["t"])
    flag = F.when(n.isNotNull() & f.isNotNull(), "ok").when(n.isNotNull(), "near_only").when(f.isNotNull(), "far_only").otherwise("none")
    iv = F.when(flag == "ok", F.sqrt(total / target)).otherwise(F.coalesce(n["v"], f["v"]))
    return out.select(*keys, iv.alias("iv"), flag.alias("flag"))


def summarize_chain(chain: DataFrame, spot: float, *, rate: float = 0.04) -> tuple[DataFrame, DataFrame]:
    """(one row a ticker and time: iv30, iv30_yahoo, m90, m110, skew, flag; the chain with k and iv of its out-of-the-money contracts)."""
    keys = ("ticker", "asof")
    terms = (*keys, "expiry")
    points = smiles(chain, spot, rate=rate, keys=terms)
    quoted = F.when(F.col("impliedVolatility") > 0, F.col("impliedVolatility")) if "impliedVolatility" in chain.columns else F.lit(None).cast("double")
    points = points.withColumn("quoted", quoted)
    years = points.groupBy(*terms).agg(F.max("years").alias("years"), F.first("forward").alias("forward"))
    found = years.join(interpolate(points, POINTS, terms), list(terms), "left").join(interpolate(points, {"yahoo": 0.0}, terms, y="quoted"), list(terms), "left")
    out = None
    for value, name in (("atm", "iv30"), ("yahoo", "iv30_yahoo"), ("m90", "m90_30"), ("m110", "m110_30")):
        one = constant_maturity(found, value).select(*keys, F.col("iv").alias(name), F.col("flag").alias(f"{name}_flag"))
        out = one if out is None else out.join(one, list(keys), "left")
    tidy = chain.join(points.select(*terms, "type", "strike", "years", "forward", "mid", "k", "iv"), [*terms, "type", "strike"], "left")
    return out.withColumn("skew", F.col("m90_30") - F.col("m110_30")), tidy


def combine_iv_hv(iv: DataFrame, hv: DataFrame) -> DataFrame:
    """Full outer join of implied and historical volatility bars on (date, ticker); columns that one lacks are null."""
    out = iv.join(hv, ["date", "ticker"], "full_outer")
    wanted = ("iv", "iv_open", "iv_high", "iv_low", "hv")
    return out.select("date", "ticker", *[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in wanted])


def last_of_key(rows: DataFrame, keys: tuple[str, ...], sequence: str) -> DataFrame:
    """The last row of each key by ``sequence``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(sequence).desc()))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")
