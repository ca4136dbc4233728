"""The panel plan: clean bars to estimators, covariates and a trimmed panel of all tickers, with its manifest."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberpanel.functions.variance import DEFAULT_ESTIMATORS, SUFFIXES, estimate, with_intraday
from emberpanel.operators import covariates as sources_of
from emberpanel.operators.cleaning import columns_like, require_ohlc, trim_warmup


@dataclass(frozen=True)
class PanelConfig:
    tickers: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    rv_window: int = 21
    annualization_factor: float = 252.0
    estimators: tuple[str, ...] = DEFAULT_ESTIMATORS
    covariates: tuple[str, ...] = ("vix", "volume", "earnings_flag")
    earnings_window_days: int = 1
    sector_funds: dict[str, str] = field(default_factory=lambda: dict(sources_of.SECTOR_FUNDS))
    default_fund: str = sources_of.DEFAULT_FUND
    fund_estimator: str = "garman_klass"
    include_daily_variance: bool = True
    dropna_rv: bool = True

    def __post_init__(self) -> None:
        if self.rv_window < 2:
            raise ValueError("rv_window must be at least 2")
        if self.annualization_factor <= 0:
            raise ValueError("annualization_factor must be positive")
        for names, known, what in ((self.estimators, SUFFIXES, "estimator"), (self.covariates, sources_of.TAGS, "covariate")):
            if unknown := [n for n in names if n not in known]:
                raise ValueError(f"unknown {what}: {', '.join(unknown)}")


def build_panel(bars: DataFrame, config: PanelConfig, *, intraday: DataFrame | None = None, **sources) -> DataFrame:
    """One plan for all tickers: rv_ columns, var_ columns, covariates; all windows share one shuffle by ticker."""
    require_ohlc(bars)
    out = bars.where(F.col("ticker").isin(list(config.tickers))) if config.tickers else bars
    if "intraday_rv" in config.estimators:
        out = with_intraday(out, intraday)
    for name in config.estimators:
        out = estimate(out, name, window=config.rv_window, factor=config.annualization_factor)
    suffixes = [SUFFIXES[n] for n in config.estimators]
    shown = [*(f"rv_{s}" for s in suffixes), *([f"var_{s}" for s in suffixes] if config.include_daily_variance else [])]
    if "sector_etf_vol" in config.covariates:
        sources = {"estimator": config.fund_estimator, "window": config.rv_window, "factor": config.annualization_factor, "funds": config.sector_funds, "default": config.default_fund} | sources
    out = sources_of.build(out.select("ticker", "date", *shown, "volume"), config.covariates, k=config.earnings_window_days, **sources)
    out = out.select("ticker", "date", *shown, *config.covariates)
    return trim_warmup(out) if config.dropna_rv else out


def summary(panel: DataFrame) -> DataFrame:
    """Rows, first and last date and known values of each column, by ticker."""
    values = [c for c in panel.columns if c not in ("ticker", "date")]
    return panel.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *[F.count(c).alias(f"n_{c}") for c in values])


def manifest(panel: DataFrame, config: PanelConfig) -> dict:
    """Provenance: configuration, what each covariate may tell ahead, and the summary of each ticker. Its rows are as many as tickers."""
    rows = [r.asDict() for r in summary(panel).orderBy("ticker").toLocalIterator()]
    return {"config": asdict(config), "columns": panel.columns, "volatilities": columns_like(panel, "rv_"), "lookahead": {c: sources_of.TAGS[c] for c in config.covariates}, "tickers": rows, "skipped": sorted(set(config.tickers) - {r["ticker"] for r in rows})}


def save(panel: DataFrame, config: PanelConfig, path: str, write_csv: bool = False) -> dict:
    """Parquet by ticker (and CSV), and manifest.json as text beside it."""
    panel.write.mode("overwrite").partitionBy("ticker").parquet(f"{path}/panel")
    if write_csv:
        panel.write.mode("overwrite").partitionBy("ticker").csv(f"{path}/panel_csv", header=True)
    found = manifest(panel, config)
    panel.sparkSession.createDataFrame([(json.dumps(found, default=str, indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return found
