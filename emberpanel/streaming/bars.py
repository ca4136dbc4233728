"""Streams: tumbling daily bars of ticks with late data, volatility state by ticker, and keyed upserts a batch at a time.

They carry the batch plans' results to Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberpanel.plans.forecasters import EWMA_DECAY


def daily_bars(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Open, high, low, close and volume of each ticker and day; ticks (ticker, ts, price, size) later than ``late`` are dropped."""
    day = F.window("ts", "1 day")
    grouped = ticks.withWatermark("ts", late).groupBy("ticker", day.alias("w"))
    bars = grouped.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))
    return bars.select("ticker", F.col("w.start").cast("date").alias("date"), "open", "high", "low", "close", "volume")


def ewma_state(values: DataFrame, decay: float = EWMA_DECAY) -> DataFrame:
    """(ticker, date, level): the exponentially weighted level after each value, kept as state by ticker."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("date")
        out = []
        for x in rows["y"]:
            level = float(x) if level is None else decay * level + (1 - decay) * float(x)
            out.append(level)
        state.update((level,))
        yield pd.DataFrame({"ticker": key[0], "date": rows["date"].to_numpy(), "level": out})

    return values.groupBy("ticker").applyInPandasWithState(work, "ticker string, date date, level double", "level double", "append", "NoTimeout")


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, upsert):
    """A writer that gives each micro-batch to ``upsert(spark, path, batch)``."""
    return rows.writeStream.foreachBatch(lambda batch, _: upsert(batch.sparkSession, path, batch)).option("checkpointLocation", checkpoint)
