"""Daily and intraday bars from files: column names and dates made uniform, one DataFrame for all tickers."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberpanel.operators.cleaning import between_dates, clean_bars, flag_bars, normalize_date, quality_report, require_ohlc

T = TypeVar("T")


def read_any(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet (.parquet, .pq) or CSV (.csv, .txt, also .gz) by the path's ending."""
    first = path if isinstance(path, str) else path[0]
    name = first.lower().rstrip("/").removesuffix(".gz")
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if name.endswith((".csv", ".txt")) or first.lower().endswith(".gz"):
        return spark.read.csv(path, header=True, inferSchema=False)
    raise ValueError(f"unsupported file type: {first}")


def retry(work: Callable[[], T], attempts: int = 3, pause: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> T | None:
    """The first result of up to ``attempts`` calls, with growing pauses; None if all fail."""
    for k in range(1, attempts + 1):
        try:
            return work()
        except Exception:  # a source may fail in any way; the caller treats None as no data
            if k < attempts:
                sleep(pause * k)
    return None


def daily_bars(source: DataFrame, tickers: list[str] | None = None, start=None, end=None, sequence: str | None = None) -> DataFrame:
    """ticker, date and prices as doubles, in lower-case names; start included, end not."""
    out = source.toDF(*[c.lower().replace(" ", "_") for c in source.columns])
    out = out.withColumn("date", normalize_date(F.col("date"))).withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("open", "high", "low", "close", "volume") if c in out.columns})
    if tickers:
        out = out.where(F.col("ticker").isin(tickers))
    out = between_dates(out, start)
    return (out.where(F.col("date") < F.lit(end).cast("date")) if end else out).where("date is not null")


def load_bars(source: DataFrame, sequence: str | None = None, **bounds) -> tuple[DataFrame, DataFrame]:
    """(clean bars, report of what was dropped); of a date's several rows the last one stays, by ``sequence`` or as they stand in the source."""
    if sequence is None:
        source = source.withColumn("_row", F.monotonically_increasing_id())
    raw = require_ohlc(daily_bars(source, **bounds))
    clean, report = clean_bars(raw, sequence or "_row"), quality_report(flag_bars(raw, sequence or "_row"))
    return clean.drop("_row"), report


def intraday_bars(source: DataFrame | None, tickers: list[str] | None = None) -> DataFrame | None:
    """ticker, ts, close; None without a source."""
    if source is None:
        return None
    out = source.select("ticker", F.to_timestamp("ts").alias("ts"), F.col("close").cast("double").alias("close"))
    return out.where(F.col("ticker").isin(tickers)) if tickers else out


def close_series(bars: DataFrame, symbol: str) -> DataFrame:
    return bars.where(F.col("ticker") == symbol).select("date", "close")


def release_dates(events: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(ticker, date) of releases, each once; empty without a source."""
    if events is None:
        return spark.createDataFrame([], "ticker string, date date")
    return events.select("ticker", normalize_date(F.col("date")).alias("date")).where("date is not null").distinct()
