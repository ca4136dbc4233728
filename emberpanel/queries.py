"""Registered queries: every operator on panels made from the test tables, and the same in SQL for DuckDB.

Bars come from lineitem (ticker = return flag, day = ship date), intraday bars from events, a second panel and releases from orders.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberpanel.functions.options import black76_price
from emberpanel.functions.variance import estimate, intraday_variance, yang_zhang_weight
from emberpanel.operators import cleaning, covariates, diagnostics, published, scores, significance, smiles
from emberpanel.operators.scores import LEVELS
from emberpanel.plans import backtest, forecasters, panel
from emberpanel.sources import archive, ivbank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Digits to which both sides round.
DIGITS = 8


def query(sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> Callable:
    """Register a query; ``sql`` is its oracle, whose ``doubles`` are rounded like every double of the query."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            swaps = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if swaps else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs -------------------------------------------------------------------------------------------------------------------

_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def daily_bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    ticks = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("date"), price.alias("p"), F.col("l_quantity").alias("q"), F.struct(*_TIES).alias("k"))
    return ticks.groupBy("ticker", "date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"))


_P, _O = "l_extendedprice / l_quantity", ", ".join(_TIES)
BARS = f"""bars AS (SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date, first({_P} ORDER BY {_O}) AS open, max({_P}) AS high,
  min({_P}) AS low, last({_P} ORDER BY {_O}) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def second_panel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    both = orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("p"), "o_orderkey")
    return both.groupBy("ticker", "date").agg(F.max_by("p", "o_orderkey").alias("close"))


SECOND = "second AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, last(o_totalprice ORDER BY o_orderkey) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def releases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's first urgent order of a quarter; orders go to tickers by number."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    dated = urgent.select(F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("ticker"), F.to_date("o_orderdate").alias("date"))
    return dated.groupBy("ticker", F.trunc("date", "quarter")).agg(F.min("date").alias("date")).select("ticker", "date")


RELEASES = """releases AS (SELECT ticker, min(date) AS date FROM (SELECT ['A', 'N', 'R'][CAST(o_orderkey % 3 + 1 AS INT)] AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT')
  GROUP BY ticker, date_trunc('quarter', date))"""


def intraday_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), "ts", F.col("value").alias("close"))


def dirty_bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with missing, negative and crossed prices, empty volumes and repeated dates, by day of the month."""
    day = F.dayofmonth("date")
    bars = daily_bars_of(spark, sf_dir).withColumn("seq", F.lit(1))
    twice = bars.where(day == 1).withColumns({"seq": F.lit(2), "close": (F.col("open") + F.col("close")) / 2})
    close = F.when(day != 11, F.col("close"))
    low = F.when(day == 13, -F.col("low")).otherwise(F.col("low"))
    high = F.when(day == 17, F.col("low") / 2).otherwise(F.col("high"))
    return bars.unionByName(twice).withColumns({"close": close, "low": low, "high": high, "volume": F.when(day == 19, 0.0).otherwise(F.col("volume"))})


DIRTY = f"""{BARS}, twice AS (SELECT *, 1 AS seq FROM bars UNION ALL SELECT * REPLACE ((open + close) / 2 AS close), 2 FROM bars WHERE day(date) = 1),
dirty AS (SELECT ticker, date, open, CASE WHEN day(date) = 17 THEN low / 2 ELSE high END AS high, CASE WHEN day(date) = 13 THEN -low ELSE low END AS low,
  CASE WHEN day(date) <> 11 THEN close END AS close, CASE WHEN day(date) = 19 THEN 0 ELSE volume END AS volume, seq FROM twice),
flagged AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) > 1 THEN 'duplicate_date' WHEN close IS NULL THEN 'missing_ohlc'
  WHEN least(open, high, low, close) <= 0 THEN 'nonpositive_price' WHEN high < greatest(open, close) OR low > least(open, close) OR high < low THEN 'ohlc_inconsistent' END AS drop_reason FROM dirty)"""

_W21 = "WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING)"
_K = yang_zhang_weight(21)
DAILY = f"""{BARS}, daily AS (SELECT *, pow(ln(close) - lag(ln(close)) OVER w, 2) AS var_cc, pow(ln(high / low), 2) / (4 * ln(2)) AS var_parkinson,
  0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS var_gk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS var_rs,
  ln(close) - lag(ln(close)) OVER w AS r, ln(open) - lag(ln(close)) OVER w AS o, ln(close / open) AS c FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
VOLS = f"""{DAILY}, vols AS (SELECT ticker, date, volume,
  sqrt(252 * CASE WHEN count(r) OVER f = 21 THEN var_samp(r) OVER f END) AS rv_cc,
  sqrt(252 * CASE WHEN count(var_parkinson) OVER f = 21 THEN avg(var_parkinson) OVER f END) AS rv_parkinson,
  sqrt(252 * CASE WHEN count(var_gk) OVER f = 21 AND avg(var_gk) OVER f >= 0 THEN avg(var_gk) OVER f END) AS rv_gk,
  sqrt(252 * CASE WHEN count(var_rs) OVER f = 21 AND avg(var_rs) OVER f >= 0 THEN avg(var_rs) OVER f END) AS rv_rs,
  sqrt(252 * CASE WHEN count(o) OVER f = 21 THEN var_samp(o) OVER f + {_K} * var_samp(c) OVER f + {1 - _K} * avg(var_rs) OVER f END) AS rv_yz FROM daily {_W21})"""
VOL_NAMES = ("rv_cc", "rv_gk", "rv_parkinson", "rv_rs", "rv_yz")


def vols_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = daily_bars_of(spark, sf_dir)
    for name in ("close_to_close", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang"):
        out = estimate(out, name)
    return out.select("ticker", "date", "volume", *VOL_NAMES)


# Estimators and cleaning ----------------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT * FROM bars", "open high low close volume")
def bars_daily(spark, sf_dir):
    return daily_bars_of(spark, sf_dir)


@query(f"WITH {DIRTY} SELECT ticker, date, seq, coalesce(drop_reason, 'kept') AS status, CASE WHEN volume > 0 THEN volume END AS volume FROM flagged", "volume")
def clean_ohlcv_flags(spark, sf_dir):
    flagged = cleaning.flag_bars(dirty_bars_of(spark, sf_dir), "seq")
    return flagged.select("ticker", "date", "seq", F.coalesce("drop_reason", F.lit("kept")).alias("status"), "volume")


@query(f"""WITH {DIRTY} SELECT ticker, drop_reason, count(*) AS dropped, array_to_string(list_sort(list_distinct(list(strftime(date, '%Y-%m-%d'))))[1:25], ',') AS dates
  FROM flagged WHERE drop_reason IS NOT NULL GROUP BY 1, 2""")
def quality_report(spark, sf_dir):
    report = cleaning.quality_report(cleaning.flag_bars(dirty_bars_of(spark, sf_dir), "seq"))
    return report.withColumn("dates", F.array_join(F.transform("dates", lambda d: d.cast("string")), ","))


def _one_variance(name: str, column: str, sql_column: str) -> None:
    def f(spark, sf_dir):
        return estimate(daily_bars_of(spark, sf_dir), name).select("ticker", "date", F.col(column).alias("variance"))

    f.__name__ = {"var_cc": "cc_variance", "var_parkinson": "parkinson", "var_gk": "garman_klass", "var_rs": "rogers_satchell", "var_yz": "yang_zhang_daily"}[column]
    query(f"WITH {DAILY} SELECT ticker, date, {sql_column} AS variance FROM daily", "variance")(f)


for _name, _column, _sql in (
    ("close_to_close", "var_cc", "var_cc"),
    ("parkinson", "var_parkinson", "var_parkinson"),
    ("garman_klass", "var_gk", "var_gk"),
    ("rogers_satchell", "var_rs", "var_rs"),
    ("yang_zhang", "var_yz", f"pow(o, 2) + {_K} * pow(c, 2) + {1 - _K} * var_rs"),
):
    _one_variance(_name, _column, _sql)


@query(f"WITH {VOLS} SELECT ticker, date, rv_cc, rv_gk, rv_parkinson, rv_rs FROM vols", "rv_cc rv_gk rv_parkinson rv_rs")
def rolling_rv_all(spark, sf_dir):
    return vols_of(spark, sf_dir).select("ticker", "date", "rv_cc", "rv_gk", "rv_parkinson", "rv_rs")


@query(f"WITH {VOLS} SELECT ticker, date, rv_yz FROM vols", "rv_yz")
def yang_zhang_windowed(spark, sf_dir):
    return vols_of(spark, sf_dir).select("ticker", "date", "rv_yz")


@query(
    """WITH moves AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, pow(ln(value) - lag(ln(value)) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts), 2) AS m
  FROM events WHERE value > 0) SELECT ticker, date, CASE WHEN count(*) >= 10 THEN coalesce(sum(m), 0) END AS intraday_rv FROM moves GROUP BY 1, 2""",
    "intraday_rv",
)
def intraday_rv(spark, sf_dir):
    return intraday_variance(intraday_of(spark, sf_dir))


@query(f"WITH {VOLS} SELECT ticker, date, rv_cc, rv_gk FROM vols WHERE rv_cc IS NOT NULL OR rv_gk IS NOT NULL", "rv_cc rv_gk")
def warmup_trim(spark, sf_dir):
    return cleaning.trim_warmup(vols_of(spark, sf_dir).select("ticker", "date", "rv_cc", "rv_gk"))


@query(f"""WITH {VOLS} SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(rv_cc) AS n_rv_cc, count(rv_gk) AS n_rv_gk, count(volume) AS n_volume
  FROM vols WHERE rv_cc IS NOT NULL OR rv_gk IS NOT NULL GROUP BY 1""")
def panel_summary(spark, sf_dir):
    config = panel.PanelConfig(estimators=("close_to_close", "garman_klass"), covariates=("volume",), include_daily_variance=False)
    return panel.summary(panel.build_panel(daily_bars_of(spark, sf_dir), config))


# Covariates -----------------------------------------------------------------------------------------------------------------


def index_of(spark, sf_dir):
    return second_panel_of(spark, sf_dir).where("ticker = 'BUILDING'").select("date", "close")


@query(
    f"""WITH {BARS}, {SECOND}, j AS (SELECT bars.ticker, bars.date, s.close AS v FROM bars LEFT JOIN (SELECT * FROM second WHERE ticker = 'BUILDING') s ON s.date = bars.date)
  SELECT ticker, date, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS vix FROM j""",
    "vix",
)
def align_ffill(spark, sf_dir):
    out = covariates.align(daily_bars_of(spark, sf_dir).select("ticker", "date"), index_of(spark, sf_dir), "close", "vix")
    return out.select("ticker", "date", "vix")


_ANCHORS = f"""{BARS}, {RELEASES}, p AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM bars),
a AS (SELECT DISTINCT r.ticker, (SELECT min(pos) FROM p WHERE p.ticker = r.ticker AND p.date >= r.date) AS pos FROM releases r)"""


@query(f"WITH {_ANCHORS} SELECT p.ticker, p.date, CAST(EXISTS (SELECT 1 FROM a WHERE a.ticker = p.ticker AND p.pos BETWEEN a.pos - 2 AND a.pos + 2) AS TINYINT) AS earnings_flag FROM p")
def earnings_flag(spark, sf_dir):
    return covariates.earnings_flag(daily_bars_of(spark, sf_dir).select("ticker", "date"), releases_of(spark, sf_dir), k=2)


@query(f"WITH {_ANCHORS} SELECT p.ticker, p.date, CAST(least(coalesce((SELECT min(a.pos) FROM a WHERE a.ticker = p.ticker AND a.pos >= p.pos) - p.pos, 63), 63) AS DOUBLE) AS days_to_earnings FROM p", "days_to_earnings")
def earnings_countdown(spark, sf_dir):
    return covariates.earnings_countdown(daily_bars_of(spark, sf_dir).select("ticker", "date"), releases_of(spark, sf_dir))


@query(
    f"""WITH {VOLS}, g AS (SELECT date, rv_gk FROM vols WHERE ticker = 'N' AND rv_gk IS NOT NULL), j AS (SELECT bars.ticker, bars.date, g.rv_gk AS v FROM bars LEFT JOIN g ON g.date = bars.date)
  SELECT ticker, date, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS sector_etf_vol FROM j""",
    "sector_etf_vol",
)
def sector_vol_join(spark, sf_dir):
    bars = daily_bars_of(spark, sf_dir)
    out = covariates.sector_vol(bars.select("ticker", "date"), bars.where("ticker = 'N'"), funds={}, default="N")
    return out.select("ticker", "date", "sector_etf_vol")


@query(
    f"""WITH {_ANCHORS}, {SECOND}, j AS (SELECT bars.ticker, bars.date, bars.volume, v.close AS v, r.close AS r FROM bars LEFT JOIN (SELECT * FROM second WHERE ticker = 'BUILDING') v ON v.date = bars.date LEFT JOIN (SELECT * FROM second WHERE ticker = 'MACHINERY') r ON r.date = bars.date)
  SELECT j.ticker, j.date, last_value(v IGNORE NULLS) OVER w AS vix, last_value(r IGNORE NULLS) OVER w AS risk_free_rate, volume, CAST(EXISTS (SELECT 1 FROM a, p WHERE a.ticker = j.ticker AND p.ticker = j.ticker AND p.date = j.date AND p.pos BETWEEN a.pos - 1 AND a.pos + 1) AS TINYINT) AS earnings_flag
  FROM j WINDOW w AS (PARTITION BY j.ticker ORDER BY j.date ROWS UNBOUNDED PRECEDING)""",
    "vix risk_free_rate volume",
)
def covariate_panel(spark, sf_dir):
    rate = second_panel_of(spark, sf_dir).where("ticker = 'MACHINERY'").select("date", "close")
    out = covariates.build(daily_bars_of(spark, sf_dir).select("ticker", "date", "volume"), ("vix", "risk_free_rate", "volume", "earnings_flag"), vix=index_of(spark, sf_dir), rate=rate, releases=releases_of(spark, sf_dir))
    return out.select("ticker", "date", "vix", "risk_free_rate", "volume", "earnings_flag")


@query(f"WITH {VOLS} SELECT vols.ticker, vols.date, rv_cc, rv_gk, var_cc, var_gk, vols.volume FROM vols JOIN daily USING (ticker, date) WHERE rv_cc IS NOT NULL OR rv_gk IS NOT NULL", "rv_cc rv_gk var_cc var_gk volume")
def panel_build(spark, sf_dir):
    return panel.build_panel(daily_bars_of(spark, sf_dir), panel.PanelConfig(estimators=("close_to_close", "garman_klass"), covariates=("volume",)))


@query(f"WITH {BARS} SELECT b.ticker, b.date, b.close, CASE WHEN b.ticker <> 'A' THEN a.close END AS \"companion_A\", CASE WHEN b.ticker <> 'R' THEN r.close END AS \"companion_R\" FROM bars b LEFT JOIN bars a ON a.ticker = 'A' AND a.date = b.date LEFT JOIN bars r ON r.ticker = 'R' AND r.date = b.date", 'close "companion_A" "companion_R"')
def companion_series(spark, sf_dir):
    return covariates.companions(daily_bars_of(spark, sf_dir).select("ticker", "date", "close"), "close", ("A", "R"))


# Diagnostics ----------------------------------------------------------------------------------------------------------------

_PAIRS = list(combinations_with_replacement(VOL_NAMES, 2))


@query(f"WITH {VOLS} " + " UNION ALL ".join(f"SELECT ticker, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation FROM vols GROUP BY 1" for a, b in _PAIRS), "correlation")
def estimator_correlation(spark, sf_dir):
    return diagnostics.correlations(vols_of(spark, sf_dir))


@query(
    f"""WITH {VOLS}, u AS ({" UNION ALL ".join(f"SELECT ticker, date, '{c}' AS estimator, {c} AS v FROM vols WHERE {c} IS NOT NULL" for c in VOL_NAMES)}),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY ticker, estimator ORDER BY date) AS d FROM u),
n AS (SELECT ticker, estimator, avg(v) AS mean, stddev_samp(v) AS std, stddev_samp(d) / avg(v) AS noise FROM d GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY noise DESC, estimator) AS INT) AS place FROM n""",
    "mean std noise",
)
def noise_ranking(spark, sf_dir):
    return diagnostics.noise_ranking(vols_of(spark, sf_dir))


_RANKS = ", ".join(f"rank() OVER (PARTITION BY ticker ORDER BY k{c}) + (count(*) OVER (PARTITION BY ticker, k{c}) - 1) / 2.0 AS r{c}" for c in "xy")
_TWO = [("rv_cc", "rv_cc"), ("rv_cc", "rv_gk"), ("rv_gk", "rv_gk")]
_TWO_SQL = " UNION ALL ".join(f"SELECT ticker || '{a}{b}' AS ticker, ticker AS t, '{a}' AS a, '{b}' AS b, round({a}, 10) AS kx, round({b}, 10) AS ky FROM vols WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _TWO)


@query(f"WITH {VOLS}, p AS ({_TWO_SQL}), r AS (SELECT *, {_RANKS} FROM p) SELECT t AS ticker, a, b, corr(rx, ry) AS correlation FROM r GROUP BY 1, 2, 3", "correlation")
def spearman_correlation(spark, sf_dir):
    return diagnostics.correlations(vols_of(spark, sf_dir).select("ticker", "date", "rv_cc", "rv_gk"), "spearman")


@query(
    f"""WITH {VOLS}, p AS ({_TWO_SQL}), s AS (SELECT l.t AS ticker, l.a, l.b, sign(l.kx - r.kx) AS sx, sign(l.ky - r.ky) AS sy FROM p l JOIN p r ON l.ticker = r.ticker AND (l.kx < r.kx OR (l.kx = r.kx AND l.ky < r.ky)))
  SELECT ticker, a, b, sum(sx * sy) / (sqrt(count(*) FILTER (sx <> 0) ) * sqrt(count(*) FILTER (sy <> 0))) AS correlation FROM s GROUP BY 1, 2, 3""",
    "correlation",
)
def kendall_correlation(spark, sf_dir):
    return diagnostics.correlations(vols_of(spark, sf_dir).select("ticker", "date", "rv_cc", "rv_gk"), "kendall")


@query(
    f"""WITH {VOLS}, b AS (SELECT ticker, rv_gk AS x, rv_cc AS y, round(rv_gk, 10) AS kx, round(rv_cc, 10) AS ky FROM vols WHERE rv_gk IS NOT NULL AND rv_cc IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY kx) + (count(*) OVER (PARTITION BY ticker, kx) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY ticker ORDER BY ky) + (count(*) OVER (PARTITION BY ticker, ky) - 1) / 2.0 AS ry FROM b)
SELECT ticker, 'ok' AS status, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman, avg(x) / avg(y) AS mean_ratio FROM r GROUP BY 1""",
    "pearson spearman mean_ratio",
)
def spearman_compare(spark, sf_dir):
    vols = vols_of(spark, sf_dir)
    return diagnostics.compare_series(vols.select("ticker", "date", F.col("rv_gk").alias("value")), vols.select("ticker", "date", F.col("rv_cc").alias("value")))


# Backtests in window expressions --------------------------------------------------------------------------------------------

HORIZONS = (1, 5, 21)
CONFIG = backtest.BacktestConfig(horizons=HORIZONS, min_train=250)
SERIES = f"""{VOLS}, s AS (SELECT ticker, date, rv_gk AS y, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM vols WHERE rv_gk IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def _results_sql(model: str, point: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{model}' AS model, ticker, date AS origin_date, target_date, {h} AS horizon, forecast, realized FROM
  (SELECT *, {point} AS forecast, lead(y, {h}) OVER w AS realized, lead(date, {h}) OVER w AS target_date FROM s WINDOW w AS (PARTITION BY ticker ORDER BY pos))
  WHERE pos >= 249 AND pos <= n - 2 AND target_date IS NOT NULL"""
        for h in HORIZONS
    )


RESULTS = f"""{SERIES}, res AS ({_results_sql("random_walk", "y")} UNION ALL {_results_sql("historical_mean", "avg(y) OVER (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING)")}),
scored AS (SELECT *, pow(realized / forecast, 2) - ln(pow(realized / forecast, 2)) - 1 AS qlike, pow(realized - forecast, 2) AS se, abs(realized - forecast) AS ae FROM res)"""


def vol_panel_of(spark, sf_dir):
    return estimate(daily_bars_of(spark, sf_dir), "garman_klass").select("ticker", "date", "rv_gk")


def naive_results_of(spark, sf_dir):
    """Both naive models' forecasts from one pass over the bars: a window each, a row a model and horizon."""
    return backtest.naive_backtests(vol_panel_of(spark, sf_dir), "rv_gk", CONFIG, ("random_walk", "historical_mean"))


def scored_of(spark, sf_dir):
    return scores.add_losses(naive_results_of(spark, sf_dir))


@query(
    f"""WITH {SERIES} SELECT ticker, date, y AS day, CASE WHEN count(y) OVER w5 = 5 THEN avg(y) OVER w5 END AS week, CASE WHEN count(y) OVER w22 = 22 THEN avg(y) OVER w22 END AS month FROM s
  WINDOW w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w22 AS (PARTITION BY ticker ORDER BY date ROWS 21 PRECEDING)""",
    "day week month",
)
def har_features(spark, sf_dir):
    from emberpanel.functions.variance import by_date, rolling

    rows = backtest.series(vol_panel_of(spark, sf_dir), "rv_gk")
    return rows.select("ticker", "date", F.col("y").alias("day"), rolling(by_date(), "y", 5).alias("week"), rolling(by_date(), "y", 22).alias("month"))


@query(f"WITH {SERIES} SELECT ticker, date, lead(y, 5) OVER w AS realized_5, lead(date, 5) OVER w AS target_date_5 FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date)", "realized_5")
def target_point(spark, sf_dir):
    rows = backtest.targets(backtest.series(vol_panel_of(spark, sf_dir), "rv_gk"), backtest.BacktestConfig(horizons=(5,)))
    return rows.select("ticker", "date", "realized_5", "target_date_5")


@query(
    f"""WITH {SERIES} SELECT ticker, date, CASE WHEN lead(y, 5) OVER w IS NOT NULL THEN sqrt(avg(y * y) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) END AS realized_5
  FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "realized_5",
)
def target_average(spark, sf_dir):
    rows = backtest.targets(backtest.series(vol_panel_of(spark, sf_dir), "rv_gk"), backtest.BacktestConfig(horizons=(5,), target="average"))
    return rows.select("ticker", "date", "realized_5")


@query(f"WITH {RESULTS} SELECT * FROM res WHERE model = 'random_walk'", "forecast realized")
def random_walk_backtest(spark, sf_dir):
    return backtest.naive_backtest(vol_panel_of(spark, sf_dir), "rv_gk", CONFIG, "random_walk")


@query(f"WITH {RESULTS} SELECT * FROM res WHERE model = 'historical_mean'", "forecast realized")
def historical_mean_backtest(spark, sf_dir):
    return backtest.naive_backtest(vol_panel_of(spark, sf_dir), "rv_gk", CONFIG, "historical_mean")


ROLLING = backtest.BacktestConfig(horizons=(5,), scheme="rolling", min_train=250)


@query(
    f"""WITH {SERIES}, c AS (SELECT *, y - lag(y, 5) OVER (PARTITION BY ticker ORDER BY pos) AS r FROM s),
q AS (SELECT ticker, date, pos, n, y, quantile_cont(r, [0.05, 0.5, 0.95]) OVER (PARTITION BY ticker ORDER BY pos ROWS 244 PRECEDING) AS q FROM c)
SELECT ticker, date AS origin_date, greatest(y + q[1], 1e-8) AS q0_05, greatest(y + q[2], 1e-8) AS q0_5, greatest(y + q[3], 1e-8) AS q0_95 FROM q WHERE pos >= 249 AND pos <= n - 2""",
    "q0_05 q0_5 q0_95",
)
def rw_quantiles(spark, sf_dir):
    return backtest.random_walk_quantiles(vol_panel_of(spark, sf_dir), "rv_gk", ROLLING, 5, (0.05, 0.5, 0.95))


# Scores ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {RESULTS} SELECT model, ticker, origin_date, horizon, qlike, se, ae FROM scored", "qlike se ae")
def qlike_losses(spark, sf_dir):
    return scored_of(spark, sf_dir).select("model", "ticker", "origin_date", "horizon", "qlike", "se", "ae")


_AGG = "avg(qlike) AS qlike, avg(se) AS se, avg(ae) AS ae, sqrt(avg(se)) AS rmse, count(forecast) AS n_obs, count(*) - count(forecast) AS n_failed"
_RATIOS = ", ".join(f"{c} / max(CASE WHEN model = 'random_walk' THEN {c} END) OVER (PARTITION BY horizon) AS {c}_ratio" for c in ("qlike", "se", "ae"))
_LOSS_DOUBLES = "qlike se ae rmse qlike_ratio se_ratio ae_ratio"
POOLED = f"pooled AS (SELECT *, {_RATIOS} FROM (SELECT model, horizon, {_AGG} FROM scored GROUP BY 1, 2))"
EQUAL = f"""assets AS (SELECT model, ticker, horizon, {_AGG} FROM scored GROUP BY 1, 2, 3), equal AS (SELECT *, {_RATIOS} FROM (SELECT model, horizon, avg(qlike) AS qlike, avg(se) AS se, avg(ae) AS ae,
  avg(rmse) AS rmse, CAST(sum(n_obs) AS BIGINT) AS n_obs, CAST(sum(n_failed) AS BIGINT) AS n_failed, count(DISTINCT ticker) AS n_assets FROM assets GROUP BY 1, 2))"""


@query(f"WITH {RESULTS}, {POOLED} SELECT * FROM pooled", _LOSS_DOUBLES)
def summary_pooled(spark, sf_dir):
    return scores.summarize(scored_of(spark, sf_dir), "random_walk")["pooled"]


@query(f"WITH {RESULTS}, {EQUAL} SELECT * FROM equal", _LOSS_DOUBLES)
def summary_equal_weighted(spark, sf_dir):
    return scores.summarize(scored_of(spark, sf_dir), "random_walk")["equal_weighted"]


@query(f"WITH {RESULTS}, {EQUAL} SELECT *, {_RATIOS.replace('PARTITION BY horizon', 'PARTITION BY ticker, horizon')} FROM assets", _LOSS_DOUBLES)
def loss_ratios(spark, sf_dir):
    return scores.summarize(scored_of(spark, sf_dir), "random_walk")["per_asset"]


@query(
    f"""WITH {SERIES}, c AS (SELECT *, y - lag(y, 5) OVER (PARTITION BY ticker ORDER BY pos) AS r, lead(y, 5) OVER (PARTITION BY ticker ORDER BY pos) AS realized FROM s),
q AS (SELECT *, quantile_cont(r, [0.05, 0.5, 0.95]) OVER (PARTITION BY ticker ORDER BY pos ROWS 244 PRECEDING) AS q FROM c),
o AS (SELECT 0.05 AS level, realized, greatest(y + q[1], 1e-8) AS q FROM q WHERE pos >= 249 AND pos <= n - 2 AND realized IS NOT NULL
  UNION ALL SELECT 0.5, realized, greatest(y + q[2], 1e-8) FROM q WHERE pos >= 249 AND pos <= n - 2 AND realized IS NOT NULL
  UNION ALL SELECT 0.95, realized, greatest(y + q[3], 1e-8) FROM q WHERE pos >= 249 AND pos <= n - 2 AND realized IS NOT NULL)
SELECT 'random_walk' AS model, 5 AS horizon, CAST(level AS DOUBLE) AS level, avg(CASE WHEN realized <= q THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS n_obs,
  avg(CASE WHEN realized <= q THEN 1.0 ELSE 0.0 END) - level AS gap FROM o GROUP BY level""",
    "coverage gap",
)
def coverage_table(spark, sf_dir):
    rows = vol_panel_of(spark, sf_dir)
    res = backtest.naive_backtest(rows, "rv_gk", ROLLING, "random_walk").join(backtest.random_walk_quantiles(rows, "rv_gk", ROLLING, 5, (0.05, 0.5, 0.95)), ["ticker", "origin_date"])
    return scores.coverage(res, ["q0_05", "q0_5", "q0_95"])


@query(f"WITH {RESULTS}, {POOLED} SELECT CAST(row_number() OVER (ORDER BY qlike, model) AS INT) AS rank, model, qlike, qlike_ratio, rmse, n_obs, n_failed FROM pooled WHERE horizon = 5", "qlike qlike_ratio rmse")
def leaderboard(spark, sf_dir):
    return scores.leaderboard(scores.summarize(scored_of(spark, sf_dir), "random_walk")["pooled"], 5)


def _mz(scale: str, x: str, y: str) -> None:
    def f(spark, sf_dir):
        return scores.mincer_zarnowitz(naive_results_of(spark, sf_dir), scale)

    f.__name__ = f"mincer_zarnowitz_{scale}"
    query(f"WITH {RESULTS}, m AS (SELECT model, horizon, {x} AS x, {y} AS y FROM res) SELECT model, horizon, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n_obs FROM m GROUP BY 1, 2", "alpha beta r2")(f)


_mz("volatility", "forecast", "realized")
_mz("variance", "forecast * forecast", "realized * realized")
_mz("log", "ln(forecast)", "ln(realized)")


@query(
    f"""WITH {RESULTS}, m AS (SELECT model, horizon, ticker, regr_intercept(realized, forecast) AS alpha, regr_slope(realized, forecast) AS beta, regr_r2(realized, forecast) AS r2, count(*) AS n FROM res GROUP BY 1, 2, 3)
  SELECT model, horizon, avg(alpha) AS alpha, avg(beta) AS beta, avg(r2) AS r2, CAST(sum(n) AS BIGINT) AS n_obs, count(alpha) AS n_assets FROM m GROUP BY 1, 2""",
    "alpha beta r2",
)
def mincer_zarnowitz_per_asset(spark, sf_dir):
    return scores.mincer_zarnowitz(naive_results_of(spark, sf_dir), per_asset=True)


@query(
    f"""WITH {RESULTS}, p AS (SELECT 'full' AS period, * FROM scored UNION ALL SELECT CASE WHEN target_date < DATE '1998-06-01' THEN 'pre' ELSE 'post' END, * FROM scored)
  SELECT *, {_RATIOS.replace("PARTITION BY horizon", "PARTITION BY period, horizon")} FROM (SELECT period, model, horizon, {_AGG} FROM p GROUP BY 1, 2, 3)""",
    _LOSS_DOUBLES,
)
def subsample_split(spark, sf_dir):
    return scores.subsamples(scored_of(spark, sf_dir), "random_walk", "1998-06-01")


# Significance ---------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {RESULTS} SELECT ticker, origin_date, avg(qlike) FILTER (model = 'historical_mean') AS historical_mean, avg(qlike) FILTER (model = 'random_walk') AS random_walk
  FROM scored WHERE horizon = 5 GROUP BY 1, 2 HAVING historical_mean IS NOT NULL AND random_walk IS NOT NULL""",
    "historical_mean random_walk",
)
def loss_matrix_pivot(spark, sf_dir):
    return significance.loss_matrix(scored_of(spark, sf_dir), 5, models=["historical_mean", "random_walk"])


_DIFFS = """d AS (SELECT a.ticker, a.origin_date, a.model, a.qlike - b.qlike AS d FROM scored a JOIN scored b ON a.ticker = b.ticker AND a.origin_date = b.origin_date AND a.horizon = b.horizon
  WHERE a.horizon = 5 AND a.model <> 'random_walk' AND b.model = 'random_walk'), e AS (SELECT *, d - avg(d) OVER (PARTITION BY model) AS e FROM d),
p AS (SELECT *, """ + ", ".join(f"e * lag(e, {k}) OVER w AS p{k}" for k in range(1, 5)) + """ FROM e WINDOW w AS (PARTITION BY model ORDER BY ticker, origin_date)),
v AS (SELECT model, count(*) AS n, avg(d) AS mean_diff, sum(e * e) / count(*) AS gamma0, (sum(e * e) + """ + " + ".join(f"{2 * (1 - k / 5)} * sum(p{k})" for k in range(1, 5)) + """) / count(*) AS long FROM p GROUP BY 1),
h AS (SELECT model, n, mean_diff, gamma0, CASE WHEN long > 0 THEN long ELSE gamma0 END / n AS variance FROM v)"""


@query(f"WITH {RESULTS}, {_DIFFS} SELECT * FROM h", "mean_diff gamma0 variance")
def hac_variance(spark, sf_dir):
    return significance.hac_variance(significance._differences(scored_of(spark, sf_dir).where("horizon = 5"), "random_walk", "qlike", ("model",)), ("model",), 5)


@query(f"WITH {RESULTS}, {_DIFFS} SELECT *, mean_diff / sqrt(variance) * sqrt(greatest((n + 1 - 10 + 20.0 / n) / n, 1e-12)) AS dm_stat FROM h", "mean_diff gamma0 variance dm_stat")
def dm_statistic(spark, sf_dir):
    return significance.dm_statistics(significance._differences(scored_of(spark, sf_dir).where("horizon = 5"), "random_walk", "qlike", ("model",)), ("model",), 5)


#: Two-sided p-value of Student's t with n - 1 degrees, by Simpson's rule over the density from 0 to the statistic.
_DENSITY = "list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(least(abs(dm_stat), 40) * i / 4000.0, 2) / (n - 1), -n / 2.0)))"
_P = f"CASE WHEN variance > 0 THEN greatest(0, 1 - 2 * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) * least(abs(dm_stat), 40) / 12000.0 * {_DENSITY}) ELSE 1.0 END"
_VERDICT = "CASE WHEN p_value >= 0.05 THEN 'equal' WHEN mean_diff < 0 THEN 'better' ELSE 'worse' END"
_DM5 = f"dm AS (SELECT *, CASE WHEN variance > 0 THEN mean_diff / sqrt(variance) * sqrt(greatest((n + 1 - 10 + 20.0 / n) / n, 1e-12)) ELSE 0 END AS dm_stat FROM h)"
_DM1 = """d AS (SELECT a.ticker, a.origin_date, a.model, a.qlike - b.qlike AS d FROM scored a JOIN scored b ON a.ticker = b.ticker AND a.origin_date = b.origin_date AND a.horizon = b.horizon
  WHERE a.horizon = 1 AND a.model <> 'random_walk' AND b.model = 'random_walk'),
h AS (SELECT ticker, model, count(*) AS n, avg(d) AS mean_diff, var_pop(d) AS gamma0, var_pop(d) / count(*) AS variance FROM d GROUP BY 1, 2),
dm AS (SELECT *, CASE WHEN variance > 0 THEN mean_diff / sqrt(variance) * sqrt(greatest((n - 1.0) / n, 1e-12)) ELSE 0 END AS dm_stat FROM h)"""


@query(f"WITH {RESULTS}, {_DIFFS}, {_DM5}, pv AS (SELECT *, {_P} AS p_value FROM dm) SELECT *, {_VERDICT} AS verdict FROM pv", "mean_diff gamma0 variance dm_stat p_value")
def dm_pvalues(spark, sf_dir):
    return significance.dm_against_benchmark(scored_of(spark, sf_dir), "random_walk", 5)


@query(f"WITH {RESULTS}, {_DM1}, p AS (SELECT *, {_P} AS p_value FROM dm) SELECT *, {_VERDICT} AS verdict FROM p", "mean_diff gamma0 variance dm_stat p_value")
def dm_per_ticker(spark, sf_dir):
    return significance.dm_against_benchmark(scored_of(spark, sf_dir), "random_walk", 1, per_ticker=True)


@query(f"WITH {RESULTS}, {_DM1}, p AS (SELECT *, {_P} AS p_value FROM dm), v AS (SELECT model, {_VERDICT} AS verdict FROM p) SELECT model, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("better", "equal", "worse")) + " FROM v GROUP BY 1")
def dm_verdict_table(spark, sf_dir):
    return significance.verdict_table(significance.dm_against_benchmark(scored_of(spark, sf_dir), "random_walk", 1, per_ticker=True))


def _mcs_sql(by: str, place: str) -> str:
    """The set of two models by the bootstrap written out: blocks of five rows from digests, their sums off running sums."""
    return f"""both_ AS (SELECT ticker, origin_date, avg(qlike) FILTER (model = 'historical_mean') AS a, avg(qlike) FILTER (model = 'random_walk') AS b FROM scored WHERE horizon = 5 GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL),
placed AS (SELECT *, {place} AS k, {by} AS set_ FROM both_),
run AS (SELECT k, set_, row_number() OVER w AS pos, sum(a) OVER w AS a, sum(b) OVER w AS b FROM placed WINDOW w AS (PARTITION BY k ORDER BY ticker, origin_date ROWS UNBOUNDED PRECEDING)),
sets AS (SELECT k, set_, max(pos) AS n, max_by(a, pos) AS all_a, max_by(b, pos) AS all_b FROM run GROUP BY 1, 2),
draws AS (SELECT *, unnest(range(CAST(ceil(n / 5.0) AS BIGINT))) AS j FROM (SELECT *, unnest(range(500)) AS draw FROM sets)),
blocks AS (SELECT *, ('0x' || substr(md5(k || ':' || draw || ':' || j), 1, 8))::BIGINT % n AS f, least(5, n - j * 5) AS long FROM draws),
ends_ AS (SELECT k, draw, f AS pos, -1 AS sign FROM blocks UNION ALL SELECT k, draw, least(f + long, n), 1 FROM blocks UNION ALL SELECT k, draw, greatest(f + long - n, 0), 1 FROM blocks),
sums AS (SELECT ends_.k, draw, sum(sign * a) AS a, sum(sign * b) AS b FROM ends_ JOIN run ON ends_.k = run.k AND ends_.pos = run.pos GROUP BY 1, 2),
moves AS (SELECT sets.k, sets.set_, sets.n, all_a / sets.n AS ma, all_b / sets.n AS mb, (sums.a - sums.b) / sets.n - (all_a - all_b) / sets.n AS moved FROM sums JOIN sets ON sums.k = sets.k),
scales AS (SELECT k, set_, n, ma, mb, sqrt(avg(moved * moved)) AS scale FROM moves GROUP BY 1, 2, 3, 4, 5),
tested AS (SELECT scales.k, scales.set_, scales.n, scales.ma, scales.mb, avg(CASE WHEN abs(moved) >= abs(scales.ma - scales.mb) THEN 1.0 ELSE 0.0 END) AS p FROM scales JOIN moves ON scales.k = moves.k GROUP BY 1, 2, 3, 4, 5),
each_ AS (SELECT *, 'historical_mean' AS model, ma AS mean_loss, ma > mb AS worst FROM tested UNION ALL SELECT *, 'random_walk', mb, mb > ma FROM tested),
mcs AS (SELECT set_ AS ticker, model, mean_loss, CASE WHEN p >= 0.1 OR worst THEN p ELSE 0.1 END AS mcs_p, p >= 0.1 OR NOT worst AS included, CAST(CASE WHEN p < 0.1 AND worst THEN 1 END AS INT) AS eliminated_at, n AS n_obs FROM each_)"""


_MCS_ALL, _MCS_EACH = _mcs_sql("CAST(NULL AS VARCHAR)", "0"), _mcs_sql("ticker", "dense_rank() OVER (ORDER BY ticker) - 1")


@query(f"WITH {RESULTS}, {_MCS_ALL} SELECT * FROM mcs", "mean_loss mcs_p")
def mcs(spark, sf_dir):
    return significance.model_confidence_sets(scored_of(spark, sf_dir), 5, draws=500)


@query(f"WITH {RESULTS}, {_MCS_EACH} SELECT * FROM mcs", "mean_loss mcs_p")
def mcs_per_ticker(spark, sf_dir):
    return significance.model_confidence_sets(scored_of(spark, sf_dir), 5, draws=500, per_ticker=True)


@query(f"WITH {RESULTS}, {_MCS_EACH} SELECT model, 100 * avg(CASE WHEN included THEN 1.0 ELSE 0.0 END) AS inclusion_pct, count(*) AS n_assets FROM mcs GROUP BY 1", "inclusion_pct")
def mcs_inclusion(spark, sf_dir):
    return significance.inclusion_rates(significance.model_confidence_sets(scored_of(spark, sf_dir), 5, draws=500, per_ticker=True))


# Published tables -----------------------------------------------------------------------------------------------------------

_OURS = [(m, h, 0.2 + 0.01 * k + 0.1 * h, 1.0 + 0.02 * k) for k, m in enumerate(("log_har", "har", "mem", "random_walk")) for h in published.HORIZONS]
_VALUES = ", ".join(f"('{m}', {h}, {q!r}::DOUBLE, {r!r}::DOUBLE)" for m, h, q, r in _OURS)
_LABELS = ", ".join(f"('{a}', '{b}')" for a, b in published.LABELS.items())
_TABLE = lambda t: ", ".join(f"('{m}', {h}, {x}::DOUBLE)" for m, own in t.items() for h, x in zip(published.HORIZONS, own, strict=True))
COMPARED = f"""ours AS (SELECT * FROM (VALUES {_VALUES}) t(model, horizon, q, r)), labels AS (SELECT * FROM (VALUES {_LABELS}) t(model, published_model)),
ratios AS (SELECT * FROM (VALUES {_TABLE(published.RATIO)}) t(published_model, horizon, published_ratio)), qlikes AS (SELECT * FROM (VALUES {_TABLE(published.QLIKE)}) t(published_model, horizon, published_qlike)),
compared AS (SELECT ours.model, ours.horizon, labels.published_model, q AS our_qlike_ew, r AS our_ratio, published_ratio, r - published_ratio AS ratio_diff, 100 * (r - published_ratio) / published_ratio AS ratio_pct_diff,
  q AS our_qlike_pooled, published_qlike, 100 * (q - published_qlike) / published_qlike AS qlike_pct_diff FROM ours LEFT JOIN labels USING (model)
  LEFT JOIN ratios ON ratios.published_model = labels.published_model AND ratios.horizon = ours.horizon LEFT JOIN qlikes ON qlikes.published_model = labels.published_model AND qlikes.horizon = ours.horizon)"""


def compared_of(spark):
    ours = spark.createDataFrame(_OURS, "model string, horizon int, qlike double, qlike_ratio double")
    return published.compare(ours, ours)


@query(f"WITH {COMPARED} SELECT * FROM compared", "our_qlike_ew our_ratio published_ratio ratio_diff ratio_pct_diff our_qlike_pooled published_qlike qlike_pct_diff")
def reference_join(spark, sf_dir):
    return compared_of(spark)


@query(f"WITH {COMPARED} SELECT avg(abs(ratio_diff)) AS mean_abs_diff, max(abs(ratio_diff)) AS max_abs_diff, avg(CASE WHEN abs(ratio_diff) < 0.10 THEN 1.0 ELSE 0.0 END) AS share_near, count(*) AS n FROM compared WHERE ratio_diff IS NOT NULL", "mean_abs_diff max_abs_diff share_near")
def reference_agreement(spark, sf_dir):
    return published.agreement(compared_of(spark))


@query(f"WITH {COMPARED} SELECT model, our_ratio, published_ratio, ratio_diff, ratio_pct_diff, our_qlike_pooled, published_qlike, qlike_pct_diff FROM compared WHERE horizon = 5", "our_ratio published_ratio ratio_diff ratio_pct_diff our_qlike_pooled published_qlike qlike_pct_diff")
def reference_headline(spark, sf_dir):
    return published.at_horizon(compared_of(spark), 5)


@query(f"WITH {COMPARED} SELECT model, " + ", ".join(f"max(our_ratio) FILTER (horizon = {h}) AS ratio_{h}" for h in published.HORIZONS) + " FROM compared GROUP BY 1", " ".join(f"ratio_{h}" for h in published.HORIZONS))
def ratio_by_horizon(spark, sf_dir):
    return published.ratio_pivot(compared_of(spark))


@query(
    f"""WITH {RESULTS}, {_MCS_EACH}, rates AS (SELECT CASE model WHEN 'random_walk' THEN 'log_har' ELSE 'har' END AS model, 100 * avg(CASE WHEN included THEN 1.0 ELSE 0.0 END) AS inclusion_pct, count(*) AS n_assets FROM mcs GROUP BY 1),
labels AS (SELECT * FROM (VALUES {_LABELS}) t(model, published_model)), published AS (SELECT * FROM (VALUES {_TABLE(published.INCLUSION)}) t(published_model, horizon, published_mcs))
SELECT published_model, rates.model, inclusion_pct, n_assets, published_mcs FROM rates LEFT JOIN labels USING (model) LEFT JOIN published USING (published_model) WHERE horizon = 5""",
    "inclusion_pct published_mcs",
)
def reference_inclusion(spark, sf_dir):
    sets = significance.model_confidence_sets(scored_of(spark, sf_dir), 5, draws=500, per_ticker=True)
    named = sets.withColumn("model", F.when(F.col("model") == "random_walk", "log_har").otherwise("har"))
    return published.with_inclusion(significance.inclusion_rates(named), 5).select("published_model", "model", "inclusion_pct", "n_assets", "published_mcs")


# Implied volatility ---------------------------------------------------------------------------------------------------------

#: A made chain: spot 200, a smile in strike, four expiries in years.
_SIGMA = "0.2 + 0.3 * pow(ln(strike / 200.0), 2) + 0.05 * years"
CHAIN = f"""grid AS (SELECT 170 + 1.25 * s AS strike, y / 365.0 AS years, t AS type FROM (SELECT unnest(range(49)) AS s), (SELECT unnest([24, 38, 66, 94]) AS y), (SELECT unnest(['call', 'put']) AS t)),
priced AS (SELECT *, {_SIGMA} AS sigma FROM grid)"""


def chain_of(spark):
    grid = spark.range(49).selectExpr("170 + 1.25D * id as strike").crossJoin(spark.createDataFrame([(24,), (38,), (66,), (94,)], "y int").selectExpr("y / 365.0D as years", "y as expiry")).crossJoin(spark.createDataFrame([("call",), ("put",)], "type string"))
    grid = grid.withColumn("sigma", F.expr(_SIGMA.replace("200.0", "200.0D")))
    price = black76_price(F.lit(200.0) * F.exp(F.col("years") * 0.04), F.col("strike"), F.col("years"), F.lit(0.04), F.col("sigma"), F.col("type") == "call")
    return grid.withColumn("mid", price).withColumns({"bid": F.col("mid"), "ask": F.col("mid"), "ticker": F.lit("X"), "asof": F.lit("2026-10-01")})


@query(f"WITH {CHAIN} SELECT years, type, strike, round(sigma, 6) AS iv FROM priced WHERE CASE type WHEN 'call' THEN strike >= 200 * exp(0.04 * years) ELSE strike < 200 * exp(0.04 * years) END", "years")
def implied_vol(spark, sf_dir):
    found = smiles.smiles(chain_of(spark), 200.0)
    return found.select("years", "type", "strike", F.round("iv", 6).alias("iv"))


@query(f"WITH {CHAIN} SELECT years, round(200 * exp(0.04 * years), 6) AS forward FROM priced GROUP BY years", "years")
def implied_forward(spark, sf_dir):
    found = smiles.implied_forwards(chain_of(spark), ("ticker", "asof", "expiry"))
    return found.select((F.col("expiry") / 365.0).alias("years"), F.round("forward", 6).alias("forward"))




def _points_of(spark, sf_dir):
    bars = daily_bars_of(spark, sf_dir)
    iv = F.when(F.dayofmonth("date") % 7 != 0, F.col("volume") / 1000 + 0.1)
    return bars.select("ticker", F.year("date").alias("expiry"), (F.datediff("date", F.trunc("date", "year")) / 100.0 - 1.8).alias("k"), iv.alias("iv"))


@query(
    f"""WITH {BARS}, pts AS (SELECT ticker, year(date) AS expiry, date_diff('day', date_trunc('year', date), date) / 100.0 - 1.8 AS k, 0.1 + volume / 1000 AS iv FROM bars WHERE day(date) % 7 <> 0),
lo AS (SELECT ticker, expiry, max(k) AS k0, arg_max(iv, k) AS v0 FROM pts WHERE k <= 0.013 GROUP BY 1, 2), hi AS (SELECT ticker, expiry, min(k) AS k1, arg_min(iv, k) AS v1 FROM pts WHERE k >= 0.013 GROUP BY 1, 2),
ks AS (SELECT DISTINCT ticker, expiry FROM pts)
SELECT ticker, expiry, CASE WHEN k0 = k1 THEN v0 ELSE v0 + (v1 - v0) / (k1 - k0) * (0.013 - k0) END AS atm FROM ks LEFT JOIN lo USING (ticker, expiry) LEFT JOIN hi USING (ticker, expiry)""",
    "atm",
)
def smile_interpolation(spark, sf_dir):
    return smiles.interpolate(_points_of(spark, sf_dir), {"atm": 0.013}, ("ticker", "expiry"))


@query(
    f"""WITH {BARS}, terms AS (SELECT ticker, CAST(year(date) AS INT) AS yr, (dayofyear(date) - 1) / 365.0 AS years, 0.1 + volume / 1000 AS v FROM bars),
ok AS (SELECT * FROM terms WHERE years >= 7 / 365.0), n AS (SELECT ticker, yr, max(years) AS t0, arg_max(v, years) AS v0 FROM ok WHERE years <= 30 / 365.0 GROUP BY 1, 2),
f AS (SELECT ticker, yr, min(years) AS t1, arg_min(v, years) AS v1 FROM ok WHERE years > 30 / 365.0 GROUP BY 1, 2), ks AS (SELECT DISTINCT ticker, yr FROM terms)
SELECT ticker, yr, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN sqrt((v0 * v0 * t0 + (v1 * v1 * t1 - v0 * v0 * t0) * (30 / 365.0 - t0) / (t1 - t0)) / (30 / 365.0)) ELSE coalesce(v0, v1) END AS iv,
  CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN 'ok' WHEN t0 IS NOT NULL THEN 'near_only' WHEN t1 IS NOT NULL THEN 'far_only' ELSE 'none' END AS flag FROM ks LEFT JOIN n USING (ticker, yr) LEFT JOIN f USING (ticker, yr)""",
    "iv",
)
def constant_maturity(spark, sf_dir):
    terms = daily_bars_of(spark, sf_dir).select("ticker", F.year("date").alias("yr"), ((F.dayofyear("date") - 1) / 365.0).alias("years"), (F.col("volume") / 1000 + 0.1).alias("v"))
    return smiles.constant_maturity(terms, "v", ("ticker", "yr"))


_AT = {"atm": 0.0, "m90": math.log(0.9), "m110": math.log(1.1)}
_MATURED = "sqrt((near.{v} * near.{v} * near.t + (far.{v} * far.{v} * far.t - near.{v} * near.{v} * near.t) * (30 / 365.0 - near.t) / (far.t - near.t)) / (30 / 365.0))"
_BETWEEN = ", ".join(f"max(CASE WHEN k <= {k0!r} THEN {{'k': k, 'v': sigma}} END) AS lo_{c}, min(CASE WHEN k >= {k0!r} THEN {{'k': k, 'v': sigma}} END) AS hi_{c}" for c, k0 in _AT.items())
_LINES = ", ".join(f"CASE WHEN lo_{c}.k = hi_{c}.k THEN lo_{c}.v ELSE lo_{c}.v + (hi_{c}.v - lo_{c}.v) / (hi_{c}.k - lo_{c}.k) * ({k0!r} - lo_{c}.k) END AS {c}" for c, k0 in _AT.items())


@query(
    f"""WITH {CHAIN}, otm AS (SELECT *, ln(strike / (200 * exp(0.04 * years))) AS k FROM priced WHERE CASE type WHEN 'call' THEN strike >= 200 * exp(0.04 * years) ELSE strike < 200 * exp(0.04 * years) END),
ends_ AS (SELECT years, {_BETWEEN} FROM otm GROUP BY 1), terms AS (SELECT years AS t, {_LINES} FROM ends_),
found AS (SELECT {", ".join(_MATURED.format(v=c) + f" AS {c}" for c in _AT)} FROM (SELECT * FROM terms ORDER BY t LIMIT 1) near, (SELECT * FROM terms ORDER BY t LIMIT 1 OFFSET 1) far)
SELECT 'X' AS ticker, '2026-10-01' AS asof, atm AS iv30, 'ok' AS iv30_flag, atm AS iv30_yahoo, 'ok' AS iv30_yahoo_flag, m90 AS m90_30, 'ok' AS m90_30_flag, m110 AS m110_30, 'ok' AS m110_30_flag, m90 - m110 AS skew FROM found""",
    "iv30 iv30_yahoo m90_30 m110_30 skew",
    6,
)
def chain_summary(spark, sf_dir):
    return smiles.summarize_chain(chain_of(spark).withColumn("impliedVolatility", F.col("sigma")), 200.0)[0]


@query(
    f"""WITH {BARS}, {SECOND} SELECT coalesce(b.date, s.date) AS date, coalesce(b.ticker, s.ticker) AS ticker, b.close AS iv, b.open AS iv_open, b.high AS iv_high, b.low AS iv_low, s.close AS hv
  FROM bars b FULL JOIN (SELECT 'N' AS ticker, date, close FROM second WHERE ticker = 'BUILDING') s ON b.date = s.date AND b.ticker = s.ticker""",
    "iv iv_open iv_high iv_low hv",
)
def iv_hv_outer(spark, sf_dir):
    bars = daily_bars_of(spark, sf_dir)
    iv = bars.select("date", "ticker", F.col("close").alias("iv"), F.col("open").alias("iv_open"), F.col("high").alias("iv_high"), F.col("low").alias("iv_low"))
    hv = index_of(spark, sf_dir).select("date", F.lit("N").alias("ticker"), F.col("close").alias("hv"))
    return smiles.combine_iv_hv(iv, hv)


@query(
    f"""WITH {BARS}, old AS (SELECT date, ticker, close AS iv FROM bars WHERE year(date) <= 1997), new AS (SELECT date, ticker, open AS iv FROM bars WHERE year(date) >= 1997 AND ticker <> 'A')
  SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.date = old.date AND new.ticker = old.ticker)""",
    "iv",
)
def upsert_anti_union(spark, sf_dir):
    bars = daily_bars_of(spark, sf_dir)
    old = bars.where("year(date) <= 1997").select("date", "ticker", F.col("close").alias("iv"))
    new = bars.where("year(date) >= 1997 and ticker <> 'A'").select("date", "ticker", F.col("open").alias("iv"))
    return ivbank.upsert(old, new)


# Archive schema -------------------------------------------------------------------------------------------------------------


def measures_of(spark, sf_dir):
    """Bars dressed as an archive: a variance (some negative), a bipower variation (some missing), a quarticity."""
    bars = estimate(daily_bars_of(spark, sf_dir), "parkinson")
    day = F.dayofmonth("date")
    return bars.select("ticker", "date", F.when(day == 3, -F.col("var_parkinson")).otherwise(F.col("var_parkinson")).alias("rv5"), F.when(day != 5, F.col("var_parkinson") * (day / 20.0)).alias("bv"), F.pow("var_parkinson", F.lit(2.0)).alias("rq"))


@query(
    f"""WITH {DAILY}, m AS (SELECT ticker, date, CASE WHEN day(date) <> 3 OR var_parkinson = 0 THEN var_parkinson END AS var_rv5, CASE WHEN day(date) <> 5 THEN var_parkinson * (day(date) / 20.0) END AS var_bv, pow(var_parkinson, 2) AS var_rq FROM daily)
  SELECT ticker, date, var_rv5, var_bv, var_rq, sqrt(var_rv5) AS rv_rv5, sqrt(var_bv) AS rv_bv, CASE WHEN var_bv IS NOT NULL AND var_rv5 IS NOT NULL THEN greatest(var_rv5 - var_bv, 0) END AS jump,
  CASE WHEN var_rv5 IS NULL OR var_rv5 <= 0 THEN 'target' WHEN date < DATE '1996-01-01' THEN 'start' WHEN date > DATE '2000-12-31' THEN 'end' ELSE 'kept' END AS status FROM m""",
    "var_rv5 var_bv var_rq rv_rv5 rv_bv jump",
)
def realized_measure_schema(spark, sf_dir):
    found = cleaning.realized_schema(measures_of(spark, sf_dir), measure="rv5", variances=archive.VARIANCES, volatilities=archive.VOLATILITIES, start="1996-01-01", end="2000-12-31")
    return found.withColumn("status", F.coalesce("drop_reason", F.lit("kept"))).drop("drop_reason")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: below the checkpoint folder, or a temporary one in a local session."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root or tempfile.mkdtemp()}/{uuid.uuid4().hex}"


@query(
    f"""WITH {DAILY}, m AS (SELECT ticker, date, CASE WHEN day(date) <> 3 OR var_parkinson = 0 THEN var_parkinson END AS v, CASE WHEN ticker = 'R' AND day(date) <> 5 THEN var_parkinson * (day(date) / 20.0) END AS bv FROM daily)
  SELECT ticker, date, v AS var_rv5, sqrt(v) AS rv_rv5, bv AS var_bv, CASE WHEN bv IS NOT NULL THEN greatest(v - bv, 0) END AS jump FROM m WHERE v > 0""",
    "var_rv5 rv_rv5 var_bv jump",
)
def archive_panel(spark, sf_dir):
    """Three assets written as an archive, in folders by symbol: CSV of two column orders and names, and Parquet; read back as a panel."""
    rows, root = measures_of(spark, sf_dir), scratch(spark)
    own = lambda t: rows.where(F.col("ticker") == t)
    own("A").select("date", "rv5", "rq").write.csv(f"{root}/a", header=True)
    own("N").select(F.col("rq").alias("RQ5"), F.col("rv5").alias("realized_variance_5min"), "date").write.csv(f"{root}/n", header=True)
    own("R").select("rv5", F.col("bv").alias("bipower_variation"), "date").write.parquet(f"{root}/r")
    found, _ = archive.build_archive(spark, archive.ArchiveConfig(root=root, min_observations=1))
    return found.select("ticker", "date", "var_rv5", "rv_rv5", "var_bv", "jump")


@query(f"WITH {DAILY}, m AS (SELECT ticker, CASE WHEN day(date) <> 3 OR var_parkinson = 0 THEN var_parkinson END AS v FROM daily WHERE ticker <> 'R') SELECT ticker, count(*) AS rows, count(*) FILTER (v > 0) AS kept, count(*) FILTER (v IS NULL OR v <= 0) AS dropped_target, true AS found FROM m GROUP BY 1 UNION ALL SELECT 'GONE', 0, 0, 0, false")
def archive_report(spark, sf_dir):
    rows, root = measures_of(spark, sf_dir), scratch(spark)
    for t in ("A", "N"):
        rows.where(F.col("ticker") == t).drop("ticker").write.csv(f"{root}/{t}", header=True)
    _, report = archive.build_archive(spark, archive.ArchiveConfig(root=root, symbols=("A", "N", "gone"), min_observations=1))
    return report.select("ticker", "rows", "kept", "dropped_target", "found")


# Models in grouped-map kernels ----------------------------------------------------------------------------------------------

#: Models are fitted anew at every origin, as by the reference's default.
KERNEL = backtest.BacktestConfig(horizons=HORIZONS, scheme="rolling", min_train=500, refit_frequency=1)


def _kernel(spark, sf_dir, models, config, exog=(), rows=None):
    rows = vol_panel_of(spark, sf_dir) if rows is None else rows
    raw = backtest.run_backtest(rows, "rv_gk", models, config, exog, origins_per_task=63)
    out = backtest.results(raw)
    return out.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in out.columns])


_QUANTILES = [f"q{q:g}".replace(".", "_") for q in LEVELS]
_KERNEL_DOUBLES = " ".join(("forecast", "realized", *_QUANTILES))
_SIZE = KERNEL.min_train


def _slices(model: str, source: str, columns: str, residual, forecast: str, quantile: str, first: int) -> str:
    """Rows of one model's results. ``source`` has a row a value (ticker, pos, date, n, y, and what ``columns`` and ``residual`` name).

    For each horizon: ``columns`` (of the horizon) at each origin o, then residuals of the slice's rows i from its ``first`` on, then
    the forecast and quantiles from them (``e`` the quantiles, ``ss`` the sum of squares, ``m`` how many).
    """
    parts = []
    for h in HORIZONS:
        lead = f"lead(y, {h}) OVER w AS realized, lead(date, {h}) OVER w AS target_date"
        parts.append(f"""SELECT '{model}' AS model, ticker, date AS origin_date, target_date, CAST({h} AS INT) AS horizon, {forecast} AS forecast, realized, {", ".join(quantile.format(k=k) + f" AS {c}" for k, c in enumerate(_QUANTILES, 1))}
  FROM (SELECT o.*, quantile_cont({residual(h)}, {list(LEVELS)}) AS e, sum(pow({residual(h)}, 2)) AS ss, count(*) AS m
    FROM (SELECT *, {columns.format(h=h)}, {lead}, max(y) OVER f AS ymax, avg(y) OVER f AS ymean FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY pos), f AS (PARTITION BY ticker ORDER BY pos ROWS {_SIZE - 1} PRECEDING)) o
    JOIN (SELECT ticker AS i_ticker, pos AS i_pos, {", ".join(f"lead({c}, {h}) OVER (PARTITION BY ticker ORDER BY pos) AS t_{c}" for c in "yz")}, COLUMNS(* EXCLUDE (ticker, pos)) AS 'i_\\0' FROM {source}) i
      ON i_ticker = o.ticker AND i_pos BETWEEN o.pos - {_SIZE - 1 - first} AND o.pos - {h}
    WHERE o.pos >= {_SIZE - 1} AND o.pos <= o.n - 2 AND o.target_date IS NOT NULL GROUP BY ALL)""")
    return " UNION ALL ".join(parts)


def _solved(k: int, frame: str) -> tuple[list[str], list[str]]:
    """Columns of the normal equations over ``frame``, and then of each step of their elimination; the solution is c0, c1 and on."""
    x = lambda j: "1.0" if j == 0 else f"x{j}"
    sums = [f"sum({x(a)} * {x(b)}) OVER {frame} AS a0_{a}_{b}" for a in range(k) for b in range(a, k)]
    sums += [f"sum({x(a)} * t) OVER {frame} AS a0_{a}_{k}" for a in range(k)]
    steps = []
    for p in range(k - 1):
        steps.append(", ".join(f"a{p}_{a}_{b} - a{p}_{p}_{a} / a{p}_{p}_{p} * a{p}_{p}_{b} AS a{p + 1}_{a}_{b}" for a in range(p + 1, k) for b in range(a, k + 1)))
    for p in range(k - 1, -1, -1):
        known = "".join(f" - a{p}_{p}_{b} * c{b}" for b in range(p + 1, k))
        steps.append(f"(a{p}_{p}_{k}{known}) / a{p}_{p}_{p} AS c{p}")
    return sums, steps


def _har_sql(model: str, z: str, xs: tuple[str, ...], forecast: str, quantile: str, extra: str = "") -> str:
    """Direct least squares of z, h ahead, on ``xs`` over each slice, by normal equations."""
    k = len(xs) + 1
    parts, ctes = [], []
    means = ", ".join(f"CASE WHEN count(z) OVER w{n} = {n} THEN avg(z) OVER w{n} END AS {c}" for n, c in ((5, "week"), (22, "month")))
    named = ", ".join(f"{c} AS x{j}" for j, c in enumerate(xs, 1))
    base = f"""SELECT ticker, pos, date, n, y, z, {named} FROM (SELECT *, z AS day, {means} FROM (SELECT s.*, {z} AS z{", b.* EXCLUDE (ticker, date)" if extra else ""} FROM s {extra}) WINDOW w5 AS (PARTITION BY ticker ORDER BY pos ROWS 4 PRECEDING), w22 AS (PARTITION BY ticker ORDER BY pos ROWS 21 PRECEDING))"""
    ctes.append(f"{model}_base AS ({base})")
    for h in HORIZONS:
        frame = f"(PARTITION BY ticker ORDER BY pos ROWS BETWEEN {_SIZE - 22 - h} PRECEDING AND CURRENT ROW)"
        # Rows stand at the place of their target, so a slice ends with its origin.
        sums, steps = _solved(k, frame)
        lagged = ", ".join(f"lag(x{j}, {h}) OVER (PARTITION BY ticker ORDER BY pos) AS x{j}" for j in range(1, k))
        ctes.append(f"{model}_{h}_0 AS (SELECT ticker, pos, {', '.join(sums)} FROM (SELECT ticker, pos, z AS t, {lagged} FROM {model}_base))")
        for n, step in enumerate(steps, 1):
            ctes.append(f"{model}_{h}_{n} AS (SELECT *, {step} FROM {model}_{h}_{n - 1})")
        ctes.append(f"{model}_{h} AS (SELECT b.*, {', '.join(f'c{j}' for j in range(k))} FROM {model}_base b JOIN {model}_{h}_{len(steps)} USING (ticker, pos))")
        fitted = lambda p: "o.c0 + " + " + ".join(f"o.c{j} * {p}x{j}" for j in range(1, k))
        parts.append(
            _slices(model, f"{model}_{h}", f"c0 + {' + '.join(f'c{j} * x{j}' for j in range(1, k))} AS centre", lambda _, fitted=fitted: f"t_z - ({fitted('i_')})", forecast, quantile, 21).split(" UNION ALL ")[HORIZONS.index(h)]
        )
    return ", ".join(ctes), " UNION ALL ".join(parts)


_GUARD = "greatest(CASE WHEN {v} > 0 AND {v} <= 10 * ymax THEN {v} ELSE ymean END, 1e-8)"
_LEVEL, _ROOT = _GUARD.format(v="centre"), _GUARD.format(v="sqrt(greatest(centre, 0))")
_HAR = _har_sql("har", "y", ("day", "week", "month"), _LEVEL, "greatest(centre + e[{k}], 1e-8)")
_LOG_HAR = _har_sql("log_har", "ln(y)", ("day", "week", "month"), "greatest(exp(centre + ss / (m - 4) / 2), 1e-8)", "greatest(exp(centre + e[{k}]), 1e-8)")
_EXOG = "JOIN (SELECT ticker, date, var_parkinson * 25.2 AS jump, var_parkinson * 138.6 AS var_rsp, pow(c, 2) * 113.4 AS var_rsn, pow(var_parkinson * 252, 2) * 3 AS var_rq FROM daily) b USING (ticker, date)"
_BACK = "greatest(sqrt(greatest(centre + e[{k}], 0)), 1e-8)"
_HARJ = _har_sql("har_j", "y * y", ("day", "week", "month", "jump"), _ROOT, _BACK, _EXOG)
_HARRS = _har_sql("har_rs", "y * y", ("var_rsp", "var_rsn", "week", "month"), _ROOT, _BACK, _EXOG)
_HARQ = _har_sql("harq", "y * y", ("day", "week", "month", "sqrt(var_rq) * day"), _ROOT, _BACK, _EXOG)


@query(f"WITH {SERIES}, {_HAR[0]}, {_LOG_HAR[0]} {_HAR[1]} UNION ALL {_LOG_HAR[1]}", _KERNEL_DOUBLES, 6)
def log_har_backtest(spark, sf_dir):
    return _kernel(spark, sf_dir, {"log_har": forecasters.LogHAR, "har": forecasters.HAR}, KERNEL)


@query(f"WITH {SERIES}, {_HARJ[0]}, {_HARRS[0]}, {_HARQ[0]} {_HARJ[1]} UNION ALL {_HARRS[1]} UNION ALL {_HARQ[1]}", _KERNEL_DOUBLES, 6)
def har_exog_backtest(spark, sf_dir):
    bars = estimate(estimate(daily_bars_of(spark, sf_dir), "garman_klass"), "parkinson")
    half = F.col("var_parkinson") * 252
    fall = F.pow(F.ln(F.col("close") / F.col("open")), F.lit(2.0)) * 252
    rows = bars.select("ticker", "date", "rv_gk", (half * 0.1).alias("jump"), (half * 0.55).alias("var_rsp"), (fall * 0.45).alias("var_rsn"), (half * half * 3).alias("var_rq"))
    models = {m.name: m for m in (forecasters.HARJ, forecasters.HARRS, forecasters.HARQ)}
    return _kernel(spark, sf_dir, models, KERNEL, ("jump", "var_rsp", "var_rsn", "var_rq"), rows)


#: Levels of a slice that starts at any row, off one running sum: g is the sum of all values before, each decayed to its row.
_EWMA = f"""g AS (SELECT ticker, pos, date, n, y, y AS z, pow(0.94, pos) * sum(0.06 * y * pow(0.94, -pos)) OVER (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM s),
starts AS (SELECT *, lag(y, {_SIZE - 1}) OVER w AS y0, lag(g, {_SIZE - 1}) OVER w AS g0 FROM g WINDOW w AS (PARTITION BY ticker ORDER BY pos))"""
_EWMA_ROWS = _slices("ewma_0.94", "starts", f"g + pow(0.94, {_SIZE - 1}) * (y0 - g0) AS centre", lambda h: f"t_y - (i_g + pow(0.94, i_pos - o.pos + {_SIZE - 1}) * (o.y0 - o.g0))", "greatest(centre, 1e-8)", "greatest(centre + e[{k}], 1e-8)", 0)


@query(f"WITH {SERIES}, {_EWMA} {_EWMA_ROWS}", _KERNEL_DOUBLES, 6)
def ewma_backtest(spark, sf_dir):
    return _kernel(spark, sf_dir, {"ewma_0.94": forecasters.EWMA}, KERNEL)


@query()
def mem_backtest(spark, sf_dir):
    return _kernel(spark, sf_dir, {"mem": forecasters.MEM}, KERNEL)


@query()
def arma_backtest(spark, sf_dir):
    return _kernel(spark, sf_dir, {"arma": forecasters.ARMA}, KERNEL)


@query()
def arfima_backtest(spark, sf_dir):
    return _kernel(spark, sf_dir, {"arfima": forecasters.ARFIMA}, KERNEL)


@query(
    f"""WITH {SERIES}, m AS (SELECT unnest(['har', 'log_har']) AS model) SELECT model, ticker, count(*) FILTER (pos BETWEEN {_SIZE - 1} AND n - 2) AS origins, 0 AS failed_fits, 0 AS failed_forecasts, 0 AS floored_forecasts, 0 AS insanity_filtered
  FROM s, m GROUP BY 1, 2"""
)
def backtest_diagnostics(spark, sf_dir):
    raw = backtest.run_backtest(vol_panel_of(spark, sf_dir), "rv_gk", {"log_har": forecasters.LogHAR, "har": forecasters.HAR}, KERNEL)
    return backtest.diagnostics(raw).drop("seconds")


@query(
    f"""WITH {SERIES}, x AS (SELECT ticker, row_number() OVER w - 1 AS t, ln(y) - avg(ln(y)) OVER (PARTITION BY ticker) AS x, count(*) OVER (PARTITION BY ticker) AS n FROM s WHERE y > 0 WINDOW w AS (PARTITION BY ticker ORDER BY pos)),
f AS (SELECT ticker, n, unnest(range(1, least(greatest(4, CAST(floor(sqrt(n)) AS BIGINT)), (n - 1) // 2) + 1)) AS j FROM (SELECT DISTINCT ticker, n FROM x)),
p AS (SELECT f.ticker, f.n, f.j, (pow(sum(x * cos(2 * pi() * j * t / x.n)), 2) + pow(sum(x * sin(2 * pi() * j * t / x.n)), 2)) / (2 * pi() * f.n) AS level FROM f JOIN x ON f.ticker = x.ticker GROUP BY 1, 2, 3)
SELECT ticker, least(greatest(-regr_slope(ln(level), ln(4 * pow(sin(pi() * j / n), 2))), 0), 0.499) AS d FROM p WHERE level > 0 GROUP BY 1""",
    "d",
)
def gph_d(spark, sf_dir):
    rows = backtest.series(vol_panel_of(spark, sf_dir), "rv_gk").where("y > 0")

    def work(pdf):
        import numpy as np

        return pdf[["ticker"]].head(1).assign(d=forecasters.gph_memory(np.log(pdf.sort_values("pos")["y"].to_numpy())))

    return rows.groupBy("ticker").applyInPandas(work, "ticker string, d double")


@query(
    f"""WITH {SERIES}, x AS (SELECT ticker, pos, date, y, lag(y, 5) OVER w AS z1 FROM s WINDOW w AS (PARTITION BY ticker ORDER BY pos))
  SELECT ticker, date AS origin_date, regr_intercept(y, z1) OVER f + regr_slope(y, z1) OVER f * y AS forecast FROM x WHERE pos >= 0 WINDOW f AS (PARTITION BY ticker ORDER BY pos ROWS 244 PRECEDING) QUALIFY pos >= 249""",
    "forecast",
)
def rolling_ols_point(spark, sf_dir):
    """Direct least squares of the value five ahead on the value, over a rolling window, in window expressions."""
    w = Window.partitionBy("ticker").orderBy("pos")
    rows = backtest.series(vol_panel_of(spark, sf_dir), "rv_gk").withColumn("z", F.lag("y", 5).over(w))
    f = w.rowsBetween(-244, 0)
    fit = F.regr_intercept("y", "z").over(f) + F.regr_slope("y", "z").over(f) * F.col("y")
    return rows.withColumn("forecast", fit).where("pos >= 249").select("ticker", F.col("date").alias("origin_date"), "forecast")
