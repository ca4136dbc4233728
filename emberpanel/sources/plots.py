"""Plot-ready frames, and pictures of them where matplotlib is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberpanel.operators.cleaning import columns_like
from emberpanel.operators.diagnostics import unpivot
from emberpanel.operators.scores import parse_quantile_column, quoted


def overlay(panel: DataFrame, ticker: str) -> DataFrame:
    """(date, estimator, value) of one ticker's volatilities."""
    return unpivot(panel.where(F.col("ticker") == ticker), columns_like(panel, "rv_")).orderBy("estimator", "date")


def scatter(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(ticker, date, ours, theirs) on common dates."""
    return ours.select("ticker", "date", F.col("value").alias("ours")).join(theirs.select("ticker", "date", F.col("value").alias("theirs")), ["ticker", "date"])


def fan(results: DataFrame, model: str, ticker: str, horizon: int) -> DataFrame:
    """(target_date, realized, forecast, level, quantile) of one model's forecasts."""
    names = [c for c in results.columns if parse_quantile_column(c) is not None]
    rows = results.where((F.col("model") == model) & (F.col("ticker") == ticker) & (F.col("horizon") == horizon))
    each = F.explode(F.array(*[F.struct(F.lit(parse_quantile_column(c)).alias("level"), quoted(c).alias("quantile")) for c in names]))
    return rows.select("target_date", "realized", "forecast", each.alias("p")).select("target_date", "realized", "forecast", "p.*").orderBy("target_date", "level")


def draw(frame: DataFrame, path: str, x: str, y: str, by: str | None = None) -> bool:
    """A line picture of a plot-ready frame; False without matplotlib."""
    try:
        from matplotlib import pyplot
    except ImportError:
        return False
    data = frame.toPandas()
    figure, axes = pyplot.subplots()
    for name, part in data.groupby(by) if by else [("", data)]:
        axes.plot(part[x], part[y], label=str(name))
    axes.legend()
    figure.savefig(path)
    pyplot.close(figure)
    return True
