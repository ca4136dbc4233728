"""Tests of equal accuracy: Diebold-Mariano statistics with HAC variances, and model confidence sets by block bootstrap."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.functions.distributions import t_two_sided

MCS_SCHEMA = "model string, mean_loss double, mcs_p double, included boolean, eliminated_at int, n_obs long"


def loss_matrix(scored: DataFrame, horizon: int, loss: str = "qlike", models: list[str] | None = None) -> DataFrame:
    """(ticker, origin_date) by model, with rows that have every model. Repeated losses are averaged.

    Models without any loss are dropped first, so one that failed throughout does not empty the matrix.
    """
    rows = scored.where((F.col("horizon") == horizon) & F.col(loss).isNotNull())
    names = models or [r[0] for r in rows.select("model").distinct().orderBy("model").collect()]
    if not names:
        return rows.select("ticker", "origin_date")
    wide = rows.groupBy("ticker", "origin_date").pivot("model", names).agg(F.avg(loss))
    return wide.where(reduce(and_, [F.col(f"`{m}`").isNotNull() for m in names]))


def _differences(scored: DataFrame, benchmark: str, loss: str, keys: tuple[str, ...]) -> DataFrame:
    """Loss of each model less the benchmark's on the same origin."""
    rows = scored.where(F.col(loss).isNotNull()).groupBy("ticker", "origin_date", "horizon", "model").agg(F.avg(loss).alias("l"))
    base = rows.where(F.col("model") == benchmark).select("ticker", "origin_date", "horizon", F.col("l").alias("b"))
    both = rows.where(F.col("model") != benchmark).join(base, ["ticker", "origin_date", "horizon"])
    return both.select(*dict.fromkeys((*keys, "ticker", "model", "horizon", "origin_date")), (F.col("l") - F.col("b")).alias("d"))


def _p_values(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or n is None or np.isnan(s) or np.isnan(n) else t_two_sided(s, n) for s, n in zip(statistic, dof, strict=True)], dtype="float64")


def t_p_value(statistic: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return F.pandas_udf(_p_values, "double")(statistic, dof)


def hac_variance(differences: DataFrame, keys: tuple[str, ...], horizon: int, kernel: str = "bartlett", order: tuple[str, str] = ("ticker", "origin_date")) -> DataFrame:
    """By ``keys``: n, mean_diff, gamma0 and the variance of the mean with ``horizon`` - 1 lags (gamma0 / n if that is not positive).

    The series of a key are one after another in ``order``. Lags run within a ticker, each ticker by itself; products over the
    bounds of tickers come from the few rows at their ends.
    """
    segment, within = order
    stats = differences.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"))
    own = list(dict.fromkeys((*keys, segment)))
    w = Window.partitionBy(*own).orderBy(within)
    rows = differences.join(stats, list(keys)).withColumn("_e", F.col("d") - F.col("mean_diff"))
    lags = range(1, horizon)
    rows = rows.withColumns({"_i": F.row_number().over(w) - 1, "_m": F.count("*").over(Window.partitionBy(*own)), **{f"_p{k}": F.col("_e") * F.lag("_e", k).over(w) for k in lags}})
    out = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean_diff").alias("mean_diff"), F.sum(F.col("_e") * F.col("_e")).alias("_s0"), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_s{k}") for k in lags])
    if horizon > 1 and segment not in keys:
        sizes = rows.groupBy(*own).agg(F.first("_m").alias("_m"))
        before = F.sum("_m").over(Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1))
        starts = sizes.select(*own, F.coalesce(before, F.lit(0)).alias("_start"))
        ends = rows.where((F.col("_i") < horizon - 1) | (F.col("_i") >= F.col("_m") - (horizon - 1))).join(starts, own)
        ends = ends.select(*keys, F.col(segment).alias("_segment"), (F.col("_start") + F.col("_i")).alias("_at"), "_e")
        later = ends.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in lags]))).select(*keys, F.col("_segment").alias("_later"), (F.col("_at") - F.col("_k")).alias("_at"), "_k", F.col("_e").alias("_f"))
        met = later.join(ends, [*keys, "_at"]).where("_later != _segment")
        over = met.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("_e") * F.col("_f"))), F.lit(0.0)).alias(f"_b{k}") for k in lags])
        out = out.join(over, list(keys), "left").withColumns({f"_s{k}": F.col(f"_s{k}") + F.coalesce(f"_b{k}", F.lit(0.0)) for k in lags}).drop(*[f"_b{k}" for k in lags])
    long: Column = F.col("gamma0")
    for k in lags:
        long = long + F.col(f"_s{k}") / F.col("n") * (2.0 * (1.0 - k / horizon) if kernel == "bartlett" else 2.0)
    out = out.withColumn("gamma0", F.col("_s0") / F.col("n"))
    return out.withColumn("variance", F.when(long > 0, long).otherwise(F.col("gamma0")) / F.col("n")).select(*keys, "n", "mean_diff", "gamma0", "variance")


def dm_statistics(differences: DataFrame, keys: tuple[str, ...], horizon: int, kernel: str = "bartlett") -> DataFrame:
    """Diebold-Mariano statistics with the small-sample factor; 0 where the variance is 0; groups of fewer than 3 are left out."""
    v = hac_variance(differences, keys, horizon, kernel).where("n >= 3")
    n, h = F.col("n"), float(horizon)
    factor = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(1e-12)))
    stat = F.when(F.col("variance") > 0, F.col("mean_diff") / F.sqrt("variance") * factor).otherwise(0.0)
    return v.withColumn("dm_stat", stat)


def diebold_mariano(differences: DataFrame, keys: tuple[str, ...], horizon: int, kernel: str = "bartlett", level: float = 0.05) -> DataFrame:
    """dm_statistics with p_value (two-sided t, n - 1) and a verdict: better, worse or equal than the benchmark."""
    out = dm_statistics(differences, keys, horizon, kernel)
    p = F.when(F.col("variance") > 0, t_p_value(F.col("dm_stat"), (F.col("n") - 1).cast("double"))).otherwise(1.0)
    verdict = F.when(F.col("p_value") >= level, "equal").when(F.col("mean_diff") < 0, "better").otherwise("worse")
    return out.withColumn("p_value", p).withColumn("verdict", verdict)


def dm_against_benchmark(scored: DataFrame, benchmark: str, horizon: int, loss: str = "qlike", per_ticker: bool = False) -> DataFrame:
    keys = ("ticker", "model") if per_ticker else ("model",)
    diffs = _differences(scored.where(F.col("horizon") == horizon), benchmark, loss, keys)
    return diebold_mariano(diffs, keys, horizon)


def verdict_table(dm: DataFrame, verdicts: tuple[str, ...] = ("better", "equal", "worse")) -> DataFrame:
    return dm.groupBy("model").pivot("verdict", list(verdicts)).count().na.fill(0)


def block_starts(n: int, block: int, draws: int, seed: int) -> np.ndarray:
    """(draws, blocks) uniform starts below ``n``, by the digest of seed, draw and block: the same in every engine."""
    blocks = -(-n // block)
    digest = lambda b, j: int(hashlib.md5(f"{seed}:{b}:{j}".encode(), usedforsecurity=False).hexdigest()[:8], 16)
    return np.array([[digest(b, j) % n for j in range(blocks)] for b in range(draws)])


def eliminate(mean: np.ndarray, resampled: np.ndarray, models: list[str], n: int, alpha: float) -> pd.DataFrame:
    """Model confidence set by the range statistic from mean losses and their (draws, models) resamples over ``n`` rows.

    The worst model goes while equality is rejected at ``alpha``; a p-value is the largest so far, eliminated_at the place among those
    that went, from 1. Fewer than two models or ten rows give a set of all with p-value 1.
    """
    p_value, gone = dict.fromkeys(models, 1.0), {}
    alive, running = list(range(len(models))), 0.0
    if len(models) >= 2 and n >= 10:
        while len(alive) > 1:
            gap = mean[alive][:, None] - mean[alive]
            moved = resampled[:, alive][:, :, None] - resampled[:, alive][:, None, :] - gap
            scale = np.sqrt((moved**2).mean(0))
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(scale > 0, gap / scale, 0.0)
                null = np.where(scale > 0, np.abs(moved) / scale, 0.0).max((1, 2))
            running = max(running, float((null >= np.abs(t).max()).mean()))
            if running >= alpha:
                break
            worst = models[alive.pop(int(t.max(1).argmax()))]
            p_value[worst], gone[worst] = running, len(gone) + 1
        for m in alive:
            p_value[models[m]] = max(running, alpha)
    inside = {models[m] for m in alive}
    order = pd.array([gone.get(m) for m in models], dtype="Int32")
    table = pd.DataFrame({"model": models, "mean_loss": mean, "mcs_p": [p_value[m] for m in models], "included": [m in inside for m in models], "eliminated_at": order, "n_obs": n})
    return table.sort_values("mean_loss", kind="stable")


def confidence_set(losses: np.ndarray, models: list[str], *, alpha: float = 0.10, draws: int = 1000, block: int = 2, seed: int = 0) -> pd.DataFrame:
    """The set of (origins, models) losses that one machine holds; blocks of consecutive rows wrap around the end."""
    n, total = losses.shape
    if n < 10:
        return eliminate(losses.mean(0) if n else np.full(total, np.nan), np.zeros((0, total)), models, n, alpha)
    rows = ((block_starts(n, block, draws, seed)[:, :, None] + np.arange(block)) % n).reshape(draws, -1)[:, :n]
    return eliminate(losses.mean(0), np.stack([losses[:, m][rows].mean(1) for m in range(total)], 1), models, n, alpha)


def model_confidence_sets(scored: DataFrame, horizon: int, loss: str = "qlike", *, alpha: float = 0.10, draws: int = 1000, block: int | None = None, seed: int = 0, per_ticker: bool = False) -> DataFrame:
    """A confidence set over all rows, or one a ticker; a ticker's seed is ``seed`` plus its place in order.

    Every block of every resample is a row, and its sum the difference of two running sums, so resamples are added up in Spark; a
    task gets only the (draws, models) means of a set. Running sums go by ticker, then over tickers.
    """
    matrix = loss_matrix(scored, horizon, loss)
    models = [c for c in matrix.columns if c not in ("ticker", "origin_date")]
    if not models:
        return scored.sparkSession.createDataFrame([], f"ticker string, {MCS_SCHEMA}")
    size = block or max(horizon, 2)
    sums = [f"_s{k}" for k in range(len(models))]
    w = Window.partitionBy("ticker").orderBy("origin_date")
    rows = matrix.select("ticker", (F.row_number().over(w) - 1).alias("_i"), *[F.sum(F.col(f"`{m}`")).over(w).alias(s) for m, s in zip(models, sums, strict=True)])
    # One row a ticker from here to the offsets: what lies before it.
    tickers = matrix.groupBy("ticker").agg(F.count("*").alias("_n"), *[F.sum(F.col(f"`{m}`")).alias(f"{s}_all") for m, s in zip(models, sums, strict=True)])
    every, ahead = Window.orderBy("ticker"), Window.orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    if per_ticker:
        tickers = tickers.withColumns({"_set": F.row_number().over(every) - 1, "_start": F.lit(0), **{f"{s}_before": F.lit(0.0) for s in sums}}).withColumn("_seed", F.lit(seed) + F.col("_set"))
    else:
        tickers = tickers.withColumns({"_set": F.lit(0), "_start": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "_seed": F.lit(seed), **{f"{s}_before": F.coalesce(F.sum(f"{s}_all").over(ahead), F.lit(0.0)) for s in sums}})
    running = rows.join(tickers, "ticker").select("_set", (F.col("_start") + F.col("_i") + 1).alias("_at"), *[(F.col(s) + F.col(f"{s}_before")).alias(s) for s in sums])
    named = F.first("ticker") if per_ticker else F.lit(None).cast("string")
    sets = tickers.groupBy("_set").agg(F.sum("_n").alias("_total"), F.first("_seed").alias("_seed"), named.alias("_ticker"), *[F.sum(f"{s}_all").alias(f"{s}_all") for s in sums])
    total = F.col("_total")
    drawn = sets.select("_set", "_total", "_seed", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(total / size) - 1)))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "_seed", "_draw", "_block").cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = drawn.withColumns({"_first": F.pmod(digest, total), "_long": F.least(F.lit(size), total - F.col("_block") * size)})
    last = F.col("_first") + F.col("_long")
    # A block's sum is up to its end less up to its start; one that wraps has the whole and a rest besides. Up to 0 nothing has run.
    ends = F.array(F.struct(F.col("_first").alias("_at"), F.lit(-1.0).alias("_sign")), F.struct(F.least(last, total).alias("_at"), F.lit(1.0).alias("_sign")), F.struct(F.greatest(last - total, F.lit(0)).alias("_at"), F.lit(1.0).alias("_sign")))
    points = drawn.select("_set", "_draw", F.explode(ends).alias("_p")).select("_set", "_draw", "_p._at", "_p._sign").where("_at > 0")
    resampled = points.join(running, ["_set", "_at"]).groupBy("_set", "_draw").agg(*[F.sum(F.col("_sign") * F.col(s)).alias(s) for s in sums])
    means = resampled.join(sets, "_set")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        n, head = int(pdf["_total"].iloc[0]), pdf.iloc[0]
        out = eliminate(np.array([head[f"{s}_all"] for s in sums]) / n, pdf[sums].to_numpy() / n, models, n, alpha)
        return out.assign(ticker=head["_ticker"])

    return means.groupBy("_set").applyInPandas(work, f"ticker string, {MCS_SCHEMA}")


def inclusion_rates(sets: DataFrame) -> DataFrame:
    """Percent of tickers whose set has each model."""
    return sets.groupBy("model").agg((100.0 * F.avg(F.col("included").cast("double"))).alias("inclusion_pct"), F.count("*").alias("n_assets"))
