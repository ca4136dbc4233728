"""Published accuracy tables of forty equities at horizons 1, 5 and 22, and comparison with our own numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The published tables, models and assets, as printed.
HORIZONS = (1, 5, 22)
WINDOW = 1000
SAMPLE = ("2015-01-02", "2026-01-30")
EQUITIES = (
    "AAPL", "ADBE", "AMD", "AMGN", "AMZN", "AXP", "BA", "CAT", "CRM", "CSCO",
    "CVX", "DIS", "GE", "GOOGL", "GS", "HD", "HON", "IBM", "JNJ", "JPM",
    "KO", "MCD", "META", "MMM", "MRK", "MSFT", "NFLX", "NKE", "NVDA", "ORCL",
    "PG", "PM", "SHW", "TRV", "TSLA", "UNH", "V", "VZ", "WMT", "XOM",
)
CURRENCIES = ("AUDUSD", "EURUSD", "GBPUSD", "USDCAD", "USDJPY")
FUTURES = ("C", "CL", "ES", "GC", "NG")
OPTION_TICKERS = (*EQUITIES, "SPY")
LABELS = {"har": "HAR", "log_har": "Log-HAR", "har_j": "HAR-J", "har_rs": "HAR-RS", "harq": "HARQ", "arfima": "ARFIMA", "arma": "ARMA", "mem": "MEM"}
# Pooled QLIKE.
QLIKE = {
    "Log-HAR": (0.198, 0.301, 0.538),
    "HAR": (0.199, 0.304, 0.582),
    "HAR-J": (0.217, 0.313, 0.57),
    "HAR-RS": (0.264, 0.412, 0.639),
    "HARQ": (0.636, 0.793, 0.691),
    "ARFIMA": (0.199, 0.313, 0.583),
    "ARMA": (0.198, 0.312, 0.601),
    "MEM": (0.2, 0.31, 0.606),
    "Chronos-Bolt-S": (0.222, 0.361, 0.71),
    "Chronos-Bolt-B": (0.224, 0.357, 0.709),
    "Moirai-2.0-S": (0.207, 0.336, 0.678),
    "Moirai-MoE-S": (0.215, 0.327, 0.595),
    "Lag-Llama": (0.296, 0.466, 0.532),
    "TimesFM-2.5": (0.217, 0.365, 0.724),
    "Toto": (0.229, 0.339, 0.614),
    "Sundial": (0.198, 0.329, 0.652),
    "TTM": (0.194, 0.294, 0.521),
}
# Equal-weighted QLIKE over that of Log-HAR.
RATIO = {
    "Log-HAR": (1.0, 1.0, 1.0),
    "HAR": (0.998, 1.009, 1.07),
    "HAR-J": (1.157, 1.185, 1.099),
    "HAR-RS": (2.312, 1.774, 1.372),
    "HARQ": (5.132, 3.518, 1.329),
    "ARFIMA": (1.012, 1.049, 1.094),
    "ARMA": (1.0, 1.034, 1.112),
    "MEM": (1.014, 1.03, 1.107),
    "Chronos-Bolt-S": (1.11, 1.188, 1.302),
    "Chronos-Bolt-B": (1.121, 1.181, 1.303),
    "Moirai-2.0-S": (1.038, 1.109, 1.259),
    "Moirai-MoE-S": (1.09, 1.102, 1.14),
    "Lag-Llama": (1.532, 1.582, 1.023),
    "TimesFM-2.5": (1.086, 1.201, 1.331),
    "Toto": (1.214, 1.273, 1.157),
    "Sundial": (0.998, 1.084, 1.182),
    "TTM": (0.982, 0.986, 0.987),
}
# Percent of assets whose model confidence set has the model.
INCLUSION = {
    "Log-HAR": (86.0, 90.0, 90.0),
    "HAR": (86.0, 66.0, 54.0),
    "ARFIMA": (78.0, 56.0, 52.0),
    "ARMA": (90.0, 54.0, 38.0),
    "MEM": (76.0, 58.0, 46.0),
    "Chronos-Bolt-S": (0.0, 0.0, 14.0),
    "Moirai-2.0-S": (30.0, 10.0, 16.0),
    "Lag-Llama": (0.0, 2.0, 84.0),
    "Sundial": (92.0, 26.0, 26.0),
    "TTM": (98.0, 96.0, 94.0),
}
# Forecast-efficiency regressions: (alpha, beta, r2) by horizon.
REGRESSIONS = {
    "Log-HAR": ((-0.0004, 1.043, 0.519), (0.0008, 0.940, 0.285), (0.0061, 0.532, 0.060)),
    "TTM": ((-0.0004, 1.010, 0.521), (0.0003, 0.969, 0.295), (0.0046, 0.670, 0.078)),
}


def reference_table(spark: SparkSession, which: str) -> DataFrame:
    """(published_model, horizon, value columns) of one table: qlike, ratio, mcs or mz."""
    if which == "mz":
        rows = [(m, h, *v) for m, own in REGRESSIONS.items() for h, v in zip(HORIZONS, own, strict=True)]
        return spark.createDataFrame(rows, "published_model string, horizon int, published_alpha double, published_beta double, published_r2 double")
    tables = {"qlike": QLIKE, "ratio": RATIO, "mcs": INCLUSION}
    if which not in tables:
        raise ValueError(f"unknown table {which!r}")
    rows = [(m, h, x) for m, own in tables[which].items() for h, x in zip(HORIZONS, own, strict=True)]
    return spark.createDataFrame(rows, f"published_model string, horizon int, published_{which} double")


def _label(df: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return df.withColumn("published_model", F.element_at(names, F.col("model")))


def compare(equal_weighted: DataFrame, pooled: DataFrame | None = None, mz: DataFrame | None = None) -> DataFrame:
    """Our numbers beside the published ones by model and horizon; models that were not published keep blank columns."""
    spark = equal_weighted.sparkSession
    out = _label(equal_weighted.select("model", "horizon", F.col("qlike").alias("our_qlike_ew"), F.col("qlike_ratio").alias("our_ratio")))
    both = ["published_model", "horizon"]
    out = out.join(F.broadcast(reference_table(spark, "ratio")), both, "left")
    out = out.withColumn("ratio_diff", F.col("our_ratio") - F.col("published_ratio")).withColumn("ratio_pct_diff", F.try_divide(F.col("ratio_diff") * 100.0, F.col("published_ratio")))
    if pooled is not None:
        out = out.join(pooled.select("model", "horizon", F.col("qlike").alias("our_qlike_pooled")), ["model", "horizon"], "left").join(F.broadcast(reference_table(spark, "qlike")), both, "left")
        out = out.withColumn("qlike_pct_diff", F.try_divide((F.col("our_qlike_pooled") - F.col("published_qlike")) * 100.0, F.col("published_qlike")))
    if mz is not None:
        ours = mz.select("model", "horizon", *[F.col(c).alias(f"our_{c}") for c in ("alpha", "beta", "r2")])
        out = out.join(ours, ["model", "horizon"], "left").join(F.broadcast(reference_table(spark, "mz")), both, "left")
    return out


def at_horizon(comparison: DataFrame, horizon: int) -> DataFrame:
    """The headline columns of one horizon."""
    shown = ("model", "our_ratio", "published_ratio", "ratio_diff", "ratio_pct_diff", "our_qlike_pooled", "published_qlike", "qlike_pct_diff")
    return comparison.where(F.col("horizon") == horizon).select(*[c for c in shown if c in comparison.columns])


def ratio_pivot(comparison: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Our ratios by model, a column a horizon."""
    return comparison.groupBy("model").pivot("horizon", list(horizons)).agg(F.first("our_ratio")).select("model", *[F.col(f"`{h}`").alias(f"ratio_{h}") for h in horizons])


def with_inclusion(rates: DataFrame, horizon: int) -> DataFrame:
    """Our inclusion rates beside the published ones."""
    table = reference_table(rates.sparkSession, "mcs").where(F.col("horizon") == horizon).drop("horizon")
    return _label(rates).join(F.broadcast(table), "published_model", "left")


def agreement(comparison: DataFrame, near: float = 0.10) -> DataFrame:
    """Mean and largest absolute difference of ratios, and the share within ``near``."""
    gap = F.abs("ratio_diff")
    return comparison.where("ratio_diff is not null").agg(F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff"), F.avg((gap < near).cast("double")).alias("share_near"), F.count("*").alias("n"))
