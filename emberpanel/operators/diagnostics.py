"""Agreement and noise of volatility estimators."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.operators.cleaning import columns_like


def average_rank(value: str, keys: tuple[str, ...], digits: int = 10) -> Column:
    """Rank from 1, ties at their mean rank; values that agree to ``digits`` decimals are ties, so the last bits of a sum break none."""
    near = F.round(F.col(value), digits)
    order, tied = Window.partitionBy(*keys).orderBy(near), Window.partitionBy(*keys, near)
    return F.rank().over(order) + (F.count("*").over(tied) - 1) / 2


def unpivot(panel: DataFrame, columns: list[str], name: str = "estimator", keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    return panel.unpivot(list(keys), columns, name, "value").where("value is not null")


def correlations(panel: DataFrame, method: str = "pearson") -> DataFrame:
    """(ticker, a, b, correlation) of each two ``rv_`` columns over the dates that have both."""
    pairs = list(combinations_with_replacement(sorted(columns_like(panel, "rv_")), 2))
    if method == "pearson":
        found = panel.groupBy("ticker").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
        long = found.unpivot(["ticker"], [f"`{a}|{b}`" for a, b in pairs], "pair", "correlation")
        return long.select("ticker", F.split("pair", "\\|")[0].alias("a"), F.split("pair", "\\|")[1].alias("b"), "correlation").where("correlation is not null and not isnan(correlation)")
    both = panel.select("ticker", "date", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])).alias("p")).select("ticker", "p.*").where("x is not null and y is not null")
    if method == "spearman":
        ranked = both.select("ticker", "a", "b", average_rank("x", ("ticker", "a", "b")).alias("x"), average_rank("y", ("ticker", "a", "b")).alias("y"))
        return ranked.groupBy("ticker", "a", "b").agg(F.corr("x", "y").alias("correlation"))
    if method != "kendall":
        raise ValueError(f"unknown method {method!r}")

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["ticker", "a", "b"]].head(1).assign(correlation=kendall(pdf["x"].to_numpy(), pdf["y"].to_numpy()))

    return both.groupBy("ticker", "a", "b").applyInPandas(tau, "ticker string, a string, b string, correlation double")


def _ties(*columns: np.ndarray) -> int:
    """Pairs that agree in all columns."""
    _, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    return int((n * (n - 1) // 2).sum())


def inversions(values: np.ndarray) -> int:
    """Pairs of which the earlier value is greater: sorted runs are merged by twos, and each merge counts its own."""
    total, width = 0, 1
    values = np.array(values)
    while width < len(values):
        for at in range(0, len(values) - width, 2 * width):
            left, right = values[at : at + width], values[at + width : at + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            values[at : at + 2 * width] = np.sort(values[at : at + 2 * width], kind="stable")
        width *= 2
    return total


def kendall(x, y, digits: int = 10) -> float:
    """Kendall's tau-b; values that agree to ``digits`` decimals are ties."""
    x, y = np.round(np.asarray(x, float), digits), np.round(np.asarray(y, float), digits)
    n = len(x) * (len(x) - 1) // 2
    same_x, same_y = _ties(x), _ties(y)
    agree = n - same_x - same_y + _ties(x, y) - 2 * inversions(y[np.lexsort((y, x))])
    return agree / (math.sqrt(n - same_x) * math.sqrt(n - same_y)) if n > same_x and n > same_y else float("nan")


def noise_ranking(panel: DataFrame) -> DataFrame:
    """ticker, estimator, mean, std and noise (standard deviation of changes over the mean), noisiest first by ``place``.

    Changes are between successive known values of an estimator.
    """
    long = unpivot(panel, columns_like(panel, "rv_"))
    change = F.col("value") - F.lag("value").over(Window.partitionBy("ticker", "estimator").orderBy("date"))
    out = long.withColumn("_d", change).groupBy("ticker", "estimator").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.try_divide(F.stddev_samp("_d"), F.avg("value")).alias("noise"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("noise").desc_nulls_last(), "estimator")))


def compare_series(ours: DataFrame, theirs: DataFrame, *, factor: float = 1.0, is_variance: bool = False) -> DataFrame:
    """One row a ticker: status, n, pearson, spearman and mean ratio of two series (ticker, date, value) on their common dates."""
    other = F.sqrt(F.col("theirs") * factor) if is_variance else F.col("theirs")
    both = ours.select("ticker", "date", F.col("value").alias("x")).join(theirs.select("ticker", "date", F.col("value").alias("theirs")), ["ticker", "date"])
    both = both.withColumn("y", other).where("x is not null and y is not null")
    ranked = both.withColumns({"rx": average_rank("x", ("ticker",)), "ry": average_rank("y", ("ticker",))})
    out = ranked.groupBy("ticker").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.try_divide(F.avg("x"), F.avg("y")).alias("mean_ratio"))
    enough = F.col("n") >= 3
    return out.select("ticker", F.when(enough, "ok").otherwise("insufficient_overlap").alias("status"), "n", *[F.when(enough, F.col(c)).alias(c) for c in ("pearson", "spearman", "mean_ratio")])
