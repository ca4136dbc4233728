"""Cleaning of daily bars and of archived realized measures, with counts of what was dropped and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.functions.losses import known

#: Reasons in the order in which they are judged (fixed values).
REASONS = ("duplicate_date", "missing_ohlc", "nonpositive_price", "ohlc_inconsistent")
PRICES = ("open", "high", "low", "close")


def normalize_date(value: Column) -> Column:
    """A timestamp, date or text as a date; null if it is none.

    A text without a zone is taken as it stands; one with a zone, and a timestamp, is dated in the session's zone, UTC in the command
    lines.
    """
    return F.to_date(F.try_to_timestamp(value.cast("string")))


def require_ohlc(bars: DataFrame) -> DataFrame:
    """The bars, if they have a ticker, a date of that type and numeric prices; else ValueError. Rows need no order: windows sort them."""
    kinds = dict(bars.dtypes)
    if gone := [c for c in ("ticker", "date", *PRICES) if c not in kinds]:
        raise ValueError(f"bars lack {', '.join(gone)}")
    if kinds["date"] not in ("date", "timestamp", "timestamp_ntz"):
        raise ValueError(f"date is {kinds['date']}, not a date")
    if texts := [c for c in PRICES if kinds[c] in ("string", "boolean", "binary")]:
        raise ValueError(f"not numeric: {', '.join(texts)}")
    return bars


def flag_bars(bars: DataFrame, sequence: str | None = None) -> DataFrame:
    """The bars with drop_reason (null for good ones); of a repeated date the row last in ``sequence`` stays.

    Volume that is missing or not positive becomes null and drops no row.
    """
    bars = bars.withColumns({c: known(F.col(c).cast("double")) for c in (*PRICES, "volume") if c in bars.columns})
    order = [F.col(sequence).desc()] if sequence else [F.col(c).desc() for c in PRICES]
    rank = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(*order))
    o, h, low, c = (F.col(x) for x in PRICES)
    missing = o.isNull() | h.isNull() | low.isNull() | c.isNull()
    crossed = (h < F.greatest(o, c)) | (low > F.least(o, c)) | (h < low)
    tests = (rank > 1, missing, F.least(o, h, low, c) <= 0, crossed)
    reason = F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)])
    return bars.withColumn("drop_reason", reason).withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")))


def clean_bars(bars: DataFrame, sequence: str | None = None) -> DataFrame:
    return flag_bars(bars, sequence).where("drop_reason is null").drop("drop_reason")


def quality_report(flagged: DataFrame, sample: int = 25) -> DataFrame:
    """ticker, drop_reason, dropped and the first ``sample`` dates of each reason."""
    first = F.slice(F.array_sort(F.collect_set(F.when(F.col("_k") <= sample, F.col("date")))), 1, sample)
    ranked = flagged.where("drop_reason is not null").withColumn("_k", F.row_number().over(Window.partitionBy("ticker", "drop_reason").orderBy("date")))
    return ranked.groupBy("ticker", "drop_reason").agg(F.count("*").alias("dropped"), first.alias("dates"))


def trim_warmup(panel: DataFrame) -> DataFrame:
    """Rows with any ``rv_`` column known."""
    return panel.where(F.coalesce(*[F.col(c) for c in columns_like(panel, "rv_")]).isNotNull())


def columns_like(panel: DataFrame, prefix: str) -> list[str]:
    return [c for c in panel.columns if c.startswith(prefix)]


def mid_price(bid: Column, ask: Column) -> Column:
    """(bid + ask) / 2 for a positive bid and an ask not below it, else null."""
    return F.when((bid > 0) & (ask >= bid), (bid + ask) / 2)


def between_dates(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Rows between two dates, both included; None leaves a side open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def realized_schema(raw: DataFrame, *, measure: str, variances: tuple[str, ...], volatilities: tuple[str, ...], factor: float = 1.0, start=None, end=None) -> DataFrame:
    """Archive measures as var_<m>, rv_<m> and jump, with drop_reason (target, start, end; null for rows that stay).

    Negative variances are missing. The jump is the target above the bipower variation, not below zero, and null if either is.
    Rows without a positive target go first, then those before ``start`` or after ``end``.
    """
    there = [m for m in variances if m in raw.columns]
    value = {m: F.when(known(F.expr(f"try_cast(`{m}` as double)")) >= 0, F.expr(f"try_cast(`{m}` as double)")) for m in (*there, *(["rq"] if "rq" in raw.columns else []))}
    out = raw.withColumns({f"var_{m}": v * factor for m, v in value.items()})
    out = out.withColumns({f"rv_{m}": F.sqrt(F.col(f"var_{m}")) for m in there if m in volatilities or m == measure})
    target = F.col(f"var_{measure}")
    if "var_bv" in out.columns:
        out = out.withColumn("jump", F.when(target.isNotNull() & F.col("var_bv").isNotNull(), F.greatest(target - F.col("var_bv"), F.lit(0.0))))
    early = F.col("date") < F.lit(start).cast("date") if start else F.lit(False)
    late = F.col("date") > F.lit(end).cast("date") if end else F.lit(False)
    reason = F.when(target.isNull() | (target <= 0), "target").when(early, "start").when(late, "end")
    return out.withColumn("drop_reason", reason).drop(*value)
