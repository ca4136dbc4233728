"""Scoring of a results table: losses, summaries, ratios, coverage, forecast-efficiency regressions, subsamples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.functions.losses import LOSSES, absolute_error, known, qlike, squared_error

#: Quantile levels of forecasts (fixed values).
LEVELS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: Losses ahead of this date are the first subsample (fixed value).
BREAK_DATE = "2020-03-01"


def quantile_column(level: float) -> str:
    return f"q{level:g}"


def parse_quantile_column(name: str) -> float | None:
    """The level in a quantile column's name; None for other names."""
    try:
        level = float(name[1:].replace("_", "."))
    except ValueError:
        return None
    return level if name[:1] == "q" and 0 < level < 1 else None


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def add_losses(results: DataFrame) -> DataFrame:
    if missing := {"forecast", "realized"} - set(results.columns):
        raise KeyError(f"results lack {sorted(missing)}")
    r, f = F.col("realized"), F.col("forecast")
    return results.withColumns({"qlike": qlike(r, f), "se": squared_error(r, f), "ae": absolute_error(r, f)})


def aggregate(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean losses over known values, rmse, n_obs forecasts and n_failed missing ones."""
    f = known(F.col("forecast"))
    return scored.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in LOSSES], F.sqrt(F.avg("se")).alias("rmse"), F.count(f).alias("n_obs"), F.count_if(f.isNull()).alias("n_failed"))


def add_ratios(summary: DataFrame, benchmark: str, keys: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """Each loss over the benchmark's within ``keys``; null where the benchmark is absent. An error if it stands twice."""
    w = Window.partitionBy(*keys)
    own = F.col("model") == benchmark
    once = F.count_if(own).over(w)
    guard = F.when(once > 1, F.raise_error(F.lit(f"benchmark {benchmark} is duplicated")).cast("double"))
    return summary.withColumns({f"{c}_ratio": F.coalesce(guard, F.try_divide(F.col(c), F.max(F.when(own, F.col(c))).over(w))) for c in LOSSES})


def summarize(scored: DataFrame, benchmark: str) -> dict[str, DataFrame]:
    """pooled, per_asset and equal_weighted summaries; the last has the ratio of means over assets, not the mean of ratios."""
    pooled = add_ratios(aggregate(scored, ("model", "horizon")), benchmark)
    assets = aggregate(scored, ("model", "ticker", "horizon"))
    equal = assets.groupBy("model", "horizon").agg(*[F.avg(c).alias(c) for c in (*LOSSES, "rmse")], F.sum("n_obs").alias("n_obs"), F.sum("n_failed").alias("n_failed"), F.count_distinct("ticker").alias("n_assets"))
    return {"pooled": pooled, "per_asset": add_ratios(assets, benchmark, ("ticker", "horizon")), "equal_weighted": add_ratios(equal, benchmark)}


def coverage(results: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of realized values at or below each quantile, by model, horizon and level, over pairs that are known."""
    names = columns or [c for c in results.columns if parse_quantile_column(c) is not None]
    levels = F.array(*[F.struct(F.lit(parse_quantile_column(c)).alias("level"), known(quoted(c)).alias("q")) for c in names])
    long = results.select("model", "horizon", known(F.col("realized")).alias("r"), F.explode(levels).alias("p")).select("model", "horizon", "r", "p.level", "p.q").where("r is not null and q is not null")
    out = long.groupBy("model", "horizon", "level").agg(F.avg((F.col("r") <= F.col("q")).cast("double")).alias("coverage"), F.count("*").alias("n_obs"))
    return out.withColumn("gap", F.col("coverage") - F.col("level"))


def coverage_pivot(table: DataFrame, levels: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Coverage by model and horizon, a column a level."""
    return table.groupBy("model", "horizon").pivot("level", list(levels)).agg(F.first("coverage")).select("model", "horizon", *[F.col(f"`{q}`").alias(quantile_column(q).replace(".", "_")) for q in levels])


def leaderboard(summary: DataFrame, horizon: int, loss: str = "qlike") -> DataFrame:
    """Models of one horizon from the least loss up, with their rank from 1."""
    shown = [c for c in ("model", loss, f"{loss}_ratio", "rmse", "n_obs", "n_failed", "n_assets") if c in summary.columns]
    order = Window.orderBy(F.col(loss).asc_nulls_last(), "model")
    return summary.where(F.col("horizon") == horizon).select(F.row_number().over(order).alias("rank"), *shown)


def mincer_zarnowitz(results: DataFrame, scale: str = "volatility", per_asset: bool = False) -> DataFrame:
    """realized = alpha + beta forecast + error by model and horizon: alpha, beta, r2, n_obs.

    ``scale`` is volatility, variance or log. Null with fewer than 3 pairs or a constant forecast; r2 is null for a constant
    realized. With ``per_asset`` the coefficients are means over assets, with n_assets.
    """
    x, y = known(F.col("forecast")), known(F.col("realized"))
    if scale == "variance":
        x, y = x * x, y * y
    elif scale == "log":
        x, y = F.ln(x), F.ln(y)
    elif scale != "volatility":
        raise ValueError(f"unknown scale {scale!r}")
    keys = ["model", "horizon", *(["ticker"] if per_asset else [])]
    pairs = results.select(*keys, x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    good = (F.regr_count("y", "x") >= 3) & (F.regr_sxx("y", "x") > 0)
    fit = pairs.groupBy(*keys).agg(
        F.when(good, F.regr_intercept("y", "x")).alias("alpha"),
        F.when(good, F.regr_slope("y", "x")).alias("beta"),
        F.when(good & (F.regr_syy("y", "x") > 0), F.regr_r2("y", "x")).alias("r2"),
        F.regr_count("y", "x").alias("n_obs"),
    )
    if not per_asset:
        return fit
    return fit.groupBy("model", "horizon").agg(*[F.avg(c).alias(c) for c in ("alpha", "beta", "r2")], F.sum("n_obs").alias("n_obs"), F.count("alpha").alias("n_assets"))


def subsamples(scored: DataFrame, benchmark: str, boundary: str = BREAK_DATE) -> DataFrame:
    """Pooled summaries before and from the boundary (by target date) and of all; periods without rows are left out."""
    early = F.col("target_date") < F.lit(boundary).cast("date")
    period = F.explode(F.array(F.lit("full"), F.when(early, "pre").otherwise("post")))
    by = aggregate(scored.withColumn("period", period), ("period", "model", "horizon"))
    return add_ratios(by, benchmark, ("period", "horizon"))
