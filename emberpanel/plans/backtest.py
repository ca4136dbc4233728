"""Walk-forward backtests: native plans for origins, targets and naive forecasts, a grouped-map kernel for every model."""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.functions.losses import known
from emberpanel.operators.scores import LEVELS, quantile_column
from emberpanel.plans.forecasters import Forecaster, NotEnoughData

BASE_SCHEMA = "model string, ticker string, origin_date date, target_date date, horizon int, forecast double, realized double"
RESULT_SCHEMA = f"{BASE_SCHEMA}, " + ", ".join(f"`{quantile_column(q)}` double" for q in LEVELS)
#: Of each origin, on its first horizon's row: what went wrong, and seconds.
FLAGS = "origin int, failed_fit int, failed_forecast int, floored int, insane int, seconds double"


@dataclass(frozen=True)
class BacktestConfig:
    horizons: tuple[int, ...] = (1, 5, 21)
    scheme: str = "expanding"
    min_train: int = 250
    rolling_size: int | None = None
    refit_frequency: int = 1
    start: date | None = None
    end: date | None = None
    max_origins: int | None = None
    target: str = "point"

    def __post_init__(self) -> None:
        if not self.horizons or min(self.horizons) < 1:
            raise ValueError("horizons must be positive")
        if self.scheme not in ("expanding", "rolling"):
            raise ValueError("scheme must be expanding or rolling")
        if self.target not in ("point", "average"):
            raise ValueError("target must be point or average")
        if self.min_train < 2 or self.refit_frequency < 1:
            raise ValueError("min_train must be at least 2 and refit_frequency at least 1")

    @property
    def window(self) -> int | None:
        return None if self.scheme == "expanding" else self.rolling_size or self.min_train


def series(panel: DataFrame, value: str) -> DataFrame:
    """(ticker, date, y, pos): known values by position; horizons count these, not days."""
    rows = panel.select("ticker", "date", known(F.col(value)).alias("y")).where("y is not null")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def origins(rows: DataFrame, config: BacktestConfig) -> DataFrame:
    """The rows of origins with their step (from 0): enough history, one value ahead, within the dates, the first ones."""
    out = rows.withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))).where((F.col("pos") >= config.min_train - 1) & (F.col("pos") <= F.col("_n") - 2)).drop("_n")
    if config.start:
        out = out.where(F.col("date") >= F.lit(config.start))
    if config.end:
        out = out.where(F.col("date") <= F.lit(config.end))
    out = out.withColumn("step", F.row_number().over(Window.partitionBy("ticker").orderBy("pos")) - 1)
    return out.where(F.col("step") < config.max_origins) if config.max_origins else out


def targets(rows: DataFrame, config: BacktestConfig) -> DataFrame:
    """Add target_date_<h> and realized_<h>: the value h ahead, or the root mean square of the next h."""
    w = Window.partitionBy("ticker").orderBy("pos")
    out = {}
    for h in config.horizons:
        ahead = F.lead("y", h).over(w)
        if config.target == "average":
            ahead = F.when(ahead.isNotNull(), F.sqrt(F.avg(F.col("y") * F.col("y")).over(w.rowsBetween(1, h))))
        out |= {f"realized_{h}": ahead, f"target_date_{h}": F.lead("date", h).over(w)}
    return rows.withColumns(out)


def _frame(config: BacktestConfig):
    w = Window.partitionBy("ticker").orderBy("pos")
    return w.rowsBetween(Window.unboundedPreceding if config.window is None else 1 - config.window, 0)


def naive_backtests(panel: DataFrame, value: str, config: BacktestConfig, models: tuple[str, ...]) -> DataFrame:
    """Point forecasts of ``random_walk`` and ``historical_mean`` in window expressions alone; one shuffle by ticker for all of them."""
    points: dict[str, Column] = {"random_walk": F.col("y"), "historical_mean": F.avg("y").over(_frame(config))}
    for model in models:
        if model not in points:
            raise ValueError(f"no native plan for {model!r}")
    rows = series(panel, value).withColumns({f"_{m}": F.greatest(points[m], F.lit(1e-8)) for m in models})
    rows = origins(targets(rows, config), config)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_date_{h}").alias("target_date"), F.col(f"realized_{h}").alias("realized")) for h in config.horizons])
    made = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_{m}").alias("forecast")) for m in models])
    out = rows.select("ticker", F.col("date").alias("origin_date"), F.explode(ahead).alias("t"), made.alias("_made")).where("t.target_date is not null").withColumn("m", F.explode("_made"))
    return out.select("m.model", "ticker", "origin_date", "t.target_date", "t.horizon", "m.forecast", "t.realized")


def naive_backtest(panel: DataFrame, value: str, config: BacktestConfig, model: str) -> DataFrame:
    return naive_backtests(panel, value, config, (model,))


def random_walk_quantiles(panel: DataFrame, value: str, config: BacktestConfig, h: int, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Quantiles of the random walk at each origin: its value plus exact percentiles of past h-step changes in the training slice."""
    w = Window.partitionBy("ticker").orderBy("pos")
    rows = series(panel, value).withColumn("_r", F.col("y") - F.lag("y", h).over(w))
    first = Window.unboundedPreceding if config.window is None else 1 - config.window + h
    spread = F.percentile("_r", F.array(*[F.lit(q) for q in levels])).over(w.rowsBetween(first, 0))
    rows = origins(rows.withColumn("_q", spread), config)
    return rows.select("ticker", F.col("date").alias("origin_date"), *[F.greatest(F.col("y") + F.col("_q")[k], F.lit(1e-8)).alias(quantile_column(q).replace(".", "_")) for k, q in enumerate(levels)])


def _realized(y: np.ndarray, p: int, h: int, target: str) -> float:
    return float(y[p + h]) if target == "point" else float(np.sqrt(np.mean(y[p + 1 : p + h + 1] ** 2)))


def walk_forward(dates: np.ndarray, y: np.ndarray, exog: dict[str, np.ndarray], forecaster: Forecaster, config: BacktestConfig, steps: tuple[int, int] | None = None) -> Iterator[dict]:
    """Result rows of one model on one series; ``steps`` limits origins to a range that starts at a refit."""
    n = len(y)
    day = pd.to_datetime(pd.Series(dates)).dt.date.to_numpy()
    chosen = [p for p in range(config.min_train - 1, n - 1) if (not config.start or day[p] >= config.start) and (not config.end or day[p] <= config.end)][: config.max_origins]
    begin, end = steps or (0, len(chosen))
    forecaster.reset()
    for step in range(begin, min(end, len(chosen))):
        p, clock = chosen[step], time.perf_counter()
        low = 0 if config.window is None else max(0, p + 1 - config.window)
        past = {k: v[low : p + 1] for k, v in exog.items()}
        before = forecaster.floored, forecaster.insane
        flags = {"origin": 1, "failed_fit": 0, "failed_forecast": 0, "floored": 0, "insane": 0, "seconds": 0.0}
        ready = True
        try:
            (forecaster.fit if step % config.refit_frequency == 0 else forecaster.update)(y[low : p + 1], past)
        except (NotEnoughData, ValueError, RuntimeError, np.linalg.LinAlgError):
            ready, flags["failed_fit"] = False, 1
        rows = []
        for h in config.horizons:
            if p + h >= n:
                continue
            point, quantiles = None, {}
            if ready:
                try:
                    point, quantiles = forecaster.forecast(h)
                except (NotEnoughData, ValueError, RuntimeError, np.linalg.LinAlgError):
                    flags["failed_forecast"] += 1
            rows.append({"model": forecaster.name, "origin_date": day[p], "target_date": day[p + h], "horizon": h, "forecast": point, "realized": _realized(y, p, h, config.target)} | {quantile_column(q): quantiles.get(q) for q in LEVELS})
        flags |= {"floored": forecaster.floored - before[0], "insane": forecaster.insane - before[1], "seconds": time.perf_counter() - clock}
        for k, row in enumerate(rows):
            yield row | (flags if k == 0 else dict.fromkeys(flags, 0))


def run_backtest(panel: DataFrame, value: str, models: dict[str, Callable[[], Forecaster] | Forecaster], config: BacktestConfig, exog: tuple[str, ...] = (), origins_per_task: int | None = None) -> DataFrame:
    """Results of every model on every ticker, with flags for ``diagnostics``.

    A task has one model, ticker and block of origins. Blocks (``origins_per_task``, rounded up to whole refit cycles) start at
    a refit, so what a model keeps between refits never crosses one; without blocks a task has a whole series. A ticker's series,
    a few thousand rows, is copied to each of its blocks.
    """
    made = {}
    for name, make in models.items():
        if not (callable(make) or isinstance(make, Forecaster)):
            raise TypeError(f"{name}: a model is given as a callable that makes it, or as an instance to copy")
        made[name] = partial(copy.deepcopy, make) if isinstance(make, Forecaster) else make
    size = None if origins_per_task is None else -(-origins_per_task // config.refit_frequency) * config.refit_frequency
    rows = panel.select("ticker", "date", known(F.col(value)).alias("y"), *exog).where("y is not null")
    rows = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    if size:
        count = F.count("*").over(Window.partitionBy("ticker", "model"))
        blocks = F.greatest(F.ceil((count - config.min_train) / size), F.lit(1))
        rows = rows.withColumn("_blocks", blocks).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        block = int(pdf["block"].iloc[0])
        steps = (block * size, (block + 1) * size) if size else None
        found = walk_forward(pdf["date"].to_numpy(), pdf["y"].to_numpy(float), {c: pdf[c].to_numpy(float) for c in exog}, made[pdf["model"].iloc[0]](), config, steps)
        out = pd.DataFrame(list(found), columns=_COLUMNS)
        return out.assign(ticker=pdf["ticker"].iloc[0], model=pdf["model"].iloc[0])

    return rows.groupBy("ticker", "model", "block").applyInPandas(work, f"{RESULT_SCHEMA}, {FLAGS}")


_COLUMNS = [*(c.split()[0] for c in BASE_SCHEMA.split(", ")), *map(quantile_column, LEVELS), *(c.split()[0] for c in FLAGS.split(", "))]


def results(raw: DataFrame) -> DataFrame:
    return raw.drop(*(c.split()[0] for c in FLAGS.split(", ")))


def diagnostics(raw: DataFrame) -> DataFrame:
    """By model and ticker: origins, failed fits and forecasts, floored and filtered forecasts, seconds."""
    names = {"origin": "origins", "failed_fit": "failed_fits", "failed_forecast": "failed_forecasts", "floored": "floored_forecasts", "insane": "insanity_filtered", "seconds": "seconds"}
    return raw.groupBy("model", "ticker").agg(*[F.sum(a).alias(b) for a, b in names.items()])


def models_of(res: DataFrame) -> list[str]:
    return [r[0] for r in res.select("model").distinct().orderBy("model").collect()]
