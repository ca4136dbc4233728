"""Covariates on a panel's own dates, without looking ahead: a value is of its exact date, then carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.functions.variance import estimate

#: What a model may know of a covariate at forecast time (fixed values).
TAGS = {"vix": "past_only", "volume": "past_only", "sector_etf_vol": "past_only", "risk_free_rate": "past_only", "earnings_flag": "known_future"}
#: Sector funds of tickers; others have the default (fixed values).
SECTOR_FUNDS = {"AAPL": "XLK", "MSFT": "XLK", "NVDA": "XLK", "AMZN": "XLY", "TSLA": "XLY", "JPM": "XLF", "GS": "XLF", "XOM": "XLE", "CVX": "XLE"}
DEFAULT_FUND = "SPY"


def _w(keys=("ticker",)):
    return Window.partitionBy(*keys).orderBy("date")


def align(panel: DataFrame, series: DataFrame, value: str, name: str, *, on: tuple[str, ...] = ("date",), sequence: str | None = None) -> DataFrame:
    """Add ``name``: the series' value on the row's exact date, else the last one before it on a date of the panel.

    Of a date's several values the one last in ``sequence`` counts. A value on a date that the panel lacks is not used, and
    nothing is filled backwards.
    """
    keys = [F.col(c).alias(f"_{c}") for c in on]
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(F.col(sequence or value).desc()))
    one = series.withColumn("_k", rank).where("_k = 1").select(*keys, F.col(value).alias("_v"))
    same = None
    for c in on:
        part = panel[c] == F.col(f"_{c}")
        same = part if same is None else same & part
    out = panel.join(one, same, "left").drop(*[f"_{c}" for c in on])
    carried = F.last("_v", ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, carried).drop("_v")


def positions(panel: DataFrame) -> DataFrame:
    return panel.withColumn("pos", F.row_number().over(_w()) - 1)


def anchors(panel: DataFrame, releases: DataFrame) -> DataFrame:
    """(ticker, pos): the first session on or after each release; releases after the last session have none.

    Sessions and releases are sorted together, so each release finds its session in one pass.
    """
    sessions = positions(panel.select("ticker", "date")).select("ticker", "date", "pos")
    events = releases.where("date is not null").select("ticker", "date").distinct().select("ticker", "date", F.lit(None).cast("int").alias("pos"))
    order = Window.partitionBy("ticker").orderBy("date", F.col("pos").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    found = sessions.unionByName(events).withColumn("anchor", F.first("pos", ignorenulls=True).over(order))
    return found.where("pos is null and anchor is not null").select("ticker", F.col("anchor").alias("pos")).distinct()


def earnings_flag(panel: DataFrame, releases: DataFrame, k: int = 1) -> DataFrame:
    """1 within ``k`` sessions of a release's session, else 0."""
    marked = positions(panel).join(anchors(panel, releases).select("ticker", "pos", F.lit(1).alias("_a")), ["ticker", "pos"], "left")
    near = F.max("_a").over(_w().rowsBetween(-k, k))
    return marked.withColumn("earnings_flag", F.coalesce(near, F.lit(0)).cast("tinyint")).drop("_a", "pos")


def earnings_countdown(panel: DataFrame, releases: DataFrame, cap: int = 63) -> DataFrame:
    """days_to_earnings: sessions to the next release's session, at most ``cap``; ``cap`` where none is ahead."""
    marked = positions(panel).join(anchors(panel, releases).select("ticker", "pos", F.col("pos").alias("_a")), ["ticker", "pos"], "left")
    ahead = F.first("_a", ignorenulls=True).over(_w().rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn("days_to_earnings", F.coalesce(F.least(ahead - F.col("pos"), F.lit(cap)), F.lit(cap)).cast("double")).drop("_a", "pos")


def fund_of(ticker: Column, funds: dict[str, str] | None = None, default: str = DEFAULT_FUND) -> Column:
    out = F.lit(default)
    for name, fund in (funds or SECTOR_FUNDS).items():
        out = F.when(ticker == name, fund).otherwise(out)
    return out


def sector_vol(panel: DataFrame, fund_bars: DataFrame, *, estimator: str = "garman_klass", window: int = 21, factor: float = 252.0, funds=None, default: str = DEFAULT_FUND) -> DataFrame:
    """sector_etf_vol: rolling volatility of the ticker's sector fund, aligned on the ticker's dates."""
    vol = estimate(fund_bars, estimator, window=window, factor=factor)
    rv = next(c for c in reversed(vol.columns) if c.startswith("rv_"))
    series = vol.select(F.col("ticker").alias("fund"), "date", F.col(rv).alias("_rv")).where("_rv is not null")
    out = align(panel.withColumn("fund", fund_of(F.col("ticker"), funds, default)), series, "_rv", "sector_etf_vol", on=("fund", "date"))
    return out.drop("fund")


def build(panel: DataFrame, wanted: tuple[str, ...], *, vix: DataFrame | None = None, rate: DataFrame | None = None, releases: DataFrame | None = None, fund_bars: DataFrame | None = None, k: int = 1, **sector) -> DataFrame:
    """The wanted covariates in order; one whose source is missing is null (the flag: 0)."""
    none = F.lit(None).cast("double")
    for name in wanted:
        if name not in TAGS:
            raise ValueError(f"unknown covariate {name!r}")
        source = {"vix": vix, "risk_free_rate": rate}.get(name)
        if name in ("vix", "risk_free_rate"):
            panel = panel.withColumn(name, none) if source is None else align(panel, source, "close", name)
        elif name == "volume":
            panel = panel if "volume" in panel.columns else panel.withColumn("volume", none)
        elif name == "earnings_flag":
            panel = panel.withColumn(name, F.lit(0).cast("tinyint")) if releases is None else earnings_flag(panel, releases, k)
        else:
            panel = panel.withColumn(name, none) if fund_bars is None else sector_vol(panel, fund_bars, **sector)
    return panel


def companions(panel: DataFrame, value: str, tickers: tuple[str, ...]) -> DataFrame:
    """Add companion_<ticker> for each of ``tickers``: its value on the row's date; null on the ticker's own rows and where it has none."""
    wide = panel.where(F.col("ticker").isin(list(tickers))).groupBy(F.col("date").alias("_date")).pivot("ticker", list(tickers)).agg(F.first(value))
    out = panel.join(wide, panel["date"] == wide["_date"], "left")
    return out.select(*[panel[c] for c in panel.columns], *[F.when(panel["ticker"] != t, wide[t]).alias(f"companion_{t}") for t in tickers])


def missing_counts(panel: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows and missing values of each covariate, by ticker."""
    return panel.groupBy("ticker").agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(n).isNull()).alias(f"missing_{n}") for n in names])
