"""Operators on volatility panels: against SQL, against plain numpy, and on files."""

from __future__ import annotations

import math
from datetime import date, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberpanel import queries
from emberpanel.functions import distributions, options
from emberpanel.functions.variance import estimate, yang_zhang_weight
from emberpanel.operators import cleaning, covariates, diagnostics, published, scores, significance, smiles
from emberpanel.plans import backtest, forecasters, panel
from emberpanel.sources import archive, daily, ivbank

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "events")


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)[:19].removesuffix(" 00:00:00")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    lines = [sorted(([plain(v) for v in r] for r in f[columns].astype(object).itertuples(index=False)), key=str) for f in (got, want)]
    assert len(lines[0]) == len(lines[1])
    for a, b in zip(*lines, strict=True):
        assert a == pytest.approx(b, abs=2e-8) if all(isinstance(v, float) for v in a) else [v if not isinstance(v, float) else round(v, 6) for v in a] == [v if not isinstance(v, float) else round(v, 6) for v in b]


def walk(n, seed=3):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2015-01-02", periods=n)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = close * np.exp(rng.normal(0, 0.003, n))
    high, low = np.maximum(open_, close) * 1.004, np.minimum(open_, close) * 0.996
    return pd.DataFrame({"ticker": "T", "date": days.date, "open": open_, "high": high, "low": low, "close": close, "volume": 1e6})


def vol_series(n, seed=5):
    rng = np.random.default_rng(seed)
    x = np.empty(n)
    x[0] = -1.5
    for t in range(1, n):
        x[t] = -0.1 + 0.93 * x[t - 1] + rng.normal(0, 0.1)
    return np.exp(x)


def vol_frame(spark, n, tickers=("A", "B")):
    days = pd.bdate_range("2015-01-02", periods=n).date
    return spark.createDataFrame(pd.concat([pd.DataFrame({"ticker": t, "date": days, "y": vol_series(n, 5 + k)}) for k, t in enumerate(tickers)]))


def test_estimators_do_not_look_ahead(spark):
    bars = walk(80)
    full = estimate(spark.createDataFrame(bars), "yang_zhang", window=10).toPandas().sort_values("date")
    cut = estimate(spark.createDataFrame(bars.head(50)), "yang_zhang", window=10).toPandas().sort_values("date")
    np.testing.assert_allclose(full["rv_yz"].head(50), cut["rv_yz"], rtol=1e-12)
    assert full["rv_yz"].isna().sum() == 10
    with pytest.raises(ValueError, match="at least 2"):
        yang_zhang_weight(1)


def test_cleaning(spark):
    rows = [("T", 1, 1.0, 2.0, 0.5, 1.5, 5.0, 1), ("T", 1, 1.0, 2.0, 0.5, 1.6, 0.0, 2), ("T", 2, float("nan"), 2.0, 1.0, 1.0, 1.0, 3), ("T", 3, 0.0, 2.0, 1.0, 1.0, 1.0, 4), ("T", 4, 3.0, 2.0, 1.0, 1.0, 1.0, 5)]
    bars = spark.createDataFrame([(t, date(2020, 1, d), o, h, lo, c, v, s) for t, d, o, h, lo, c, v, s in rows], "ticker string, date date, open double, high double, low double, close double, volume double, seq int")
    flags = {r.seq: r.drop_reason for r in cleaning.flag_bars(bars, "seq").collect()}
    assert flags == {1: "duplicate_date", 2: None, 3: "missing_ohlc", 4: "nonpositive_price", 5: "ohlc_inconsistent"}
    kept = cleaning.clean_bars(bars, "seq").collect()
    assert [(r.close, r.volume) for r in kept] == [(1.6, None)]
    assert cleaning.quality_report(cleaning.flag_bars(bars, "seq")).count() == 4


def test_alignment_is_exact_then_carried(spark):
    days = [date(2020, 1, 1) + timedelta(k) for k in (0, 2, 4, 6)]
    rows = spark.createDataFrame([("T", d) for d in days], "ticker string, date date")
    source = spark.createDataFrame([(days[1], 7.0), (date(2020, 1, 4), 9.0)], "date date, close double")
    got = [r.vix for r in covariates.align(rows, source, "close", "vix").orderBy("date").collect()]
    assert got == [None, 7.0, 7.0, 7.0]
    releases = spark.createDataFrame([("T", date(2019, 1, 1)), ("T", date(2020, 1, 4)), ("T", date(2021, 1, 1))], "ticker string, date date")
    assert [r.earnings_flag for r in covariates.earnings_flag(rows, releases, 0).orderBy("date").collect()] == [1, 0, 1, 0]
    assert [r.days_to_earnings for r in covariates.earnings_countdown(rows, releases, 9).orderBy("date").collect()] == [0, 1, 0, 9]


def test_panel(spark, tmp_path):
    config = panel.PanelConfig(tickers=("T", "GONE"), rv_window=10)
    bars = spark.createDataFrame(walk(60))
    out = panel.build_panel(bars, config)
    assert out.columns[:4] == ["ticker", "date", "rv_cc", "rv_parkinson"] and out.columns[-3:] == ["vix", "volume", "earnings_flag"]
    assert out.count() == 51
    found = panel.save(out, config, str(tmp_path), write_csv=True)
    assert found["skipped"] == ["GONE"] and found["tickers"][0]["n_rows"] == 51 and found["lookahead"]["earnings_flag"] == "known_future"
    assert spark.read.parquet(f"{tmp_path}/panel").count() == 51
    for bad in ({"rv_window": 1}, {"estimators": ("x",)}, {"covariates": ("x",)}, {"annualization_factor": 0}):
        with pytest.raises(ValueError):
            panel.PanelConfig(**bad)


def test_correlations(spark):
    x = np.random.default_rng(1).normal(size=60)
    frame = pd.DataFrame({"ticker": "T", "date": pd.bdate_range("2020-01-01", periods=60).date, "rv_a": x, "rv_b": x**3 + np.random.default_rng(2).normal(size=60) * 0.3})
    rows = spark.createDataFrame(frame)
    ranks = frame[["rv_a", "rv_b"]].rank().corr().iloc[0, 1]
    got = {m: {(r.a, r.b): r.correlation for r in diagnostics.correlations(rows, m).collect()}["rv_a", "rv_b"] for m in ("pearson", "spearman", "kendall")}
    assert got["pearson"] == pytest.approx(frame[["rv_a", "rv_b"]].corr().iloc[0, 1])
    assert got["spearman"] == pytest.approx(ranks)
    d = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(frame["rv_b"].to_numpy(), frame["rv_b"].to_numpy()))
    assert got["kendall"] == pytest.approx(d.sum() / (60 * 59))
    rng = np.random.default_rng(4)
    for n in (2, 3, 50, 257):
        a, b = rng.integers(0, 9, n).astype(float), rng.integers(0, 7, n).astype(float)
        sa, sb = np.sign(np.subtract.outer(a, a)), np.sign(np.subtract.outer(b, b))
        norm = math.sqrt((sa != 0).sum() * (sb != 0).sum())
        assert diagnostics.kendall(a, b) == pytest.approx((sa * sb).sum() / norm) if norm else math.isnan(diagnostics.kendall(a, b))


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_ranks_agree_with_sql_at_every_scale(spark, scale):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('/root/testdata/sf{scale}/lineitem.parquet')")
    got = queries.QUERIES["spearman_compare"](spark, f"/root/testdata/sf{scale}").toPandas().sort_values("ticker").reset_index(drop=True)
    want = con.execute(queries.ORACLE_SQL["spearman_compare"]).fetchdf().sort_values("ticker").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(got)], check_dtype=False, rtol=0, atol=2e-8)


# forecasters and backtests


def test_har_is_least_squares():
    y = vol_series(400)
    for model, z, back in ((forecasters.HAR(), y, lambda v, s: v), (forecasters.LogHAR(), np.log(y), lambda v, s: np.exp(v + s / 2)), (forecasters.LogHAR(correction=False), np.log(y), lambda v, s: np.exp(v))):
        model.fit(y)
        for h in (1, 5):
            x = np.array([[1, z[t], z[t - 4 : t + 1].mean(), z[t - 21 : t + 1].mean()] for t in range(21, 400)])
            beta, *_ = np.linalg.lstsq(x[:-h], z[21 + h :], rcond=None)
            error = z[21 + h :] - x[:-h] @ beta
            point, quantiles = model.forecast(h)
            assert point == pytest.approx(back(x[-1] @ beta, error @ error / (len(error) - 4)))
            assert list(quantiles.values()) == sorted(quantiles.values())


def test_models_recover_what_made_the_data():
    rng = np.random.default_rng(9)
    n = 1500
    x, mu = np.empty(n), 1.0
    for t in range(n):
        x[t] = mu * rng.gamma(20, 1 / 20)
        mu = 0.1 + 0.3 * x[t] + 0.6 * mu
    mem = forecasters.MEM()
    mem.fit(x)
    assert mem.p == pytest.approx([0.1, 0.3, 0.6], abs=0.08)
    e = rng.normal(0, 0.1, n)
    w = np.empty(n)
    w[0] = 0
    for t in range(1, n):
        w[t] = 0.9 * w[t - 1] + e[t] - 0.4 * e[t - 1]
    arma = forecasters.ARMA()
    arma.fit(np.exp(w - 1))
    assert arma.p == pytest.approx((-1, 0.9, -0.4), abs=0.12)
    far = arma.forecast(200)[0]
    assert math.log(far) == pytest.approx(arma.p[0], abs=0.01)
    noise = rng.normal(0, 1, 6000)
    memory = np.convolve(noise, forecasters.binomial_weights(-0.35, 3000))[:6000][3000:]
    assert forecasters.gph_memory(memory) == pytest.approx(0.35, abs=0.15)
    series = forecasters.fractional_difference(memory, 0.35, 3000)
    assert np.corrcoef(series, noise[3000:])[0, 1] > 0.9
    arfima = forecasters.ARFIMA()
    arfima.fit(np.exp(0.1 * memory))
    assert all(0 < arfima.forecast(h)[0] < 10 for h in (1, 5, 22))
    before = arfima.d
    arfima.update(np.exp(0.1 * memory[:-1]))
    assert arfima.d == before


def test_naive_models_and_guards():
    y = vol_series(60)
    walk_model = forecasters.RandomWalk()
    walk_model.fit(y)
    point, quantiles = walk_model.forecast(3)
    assert point == y[-1] and quantiles[0.5] == pytest.approx(max(1e-8, y[-1] + np.median(y[3:] - y[:-3])))
    ewma = forecasters.EWMA()
    ewma.fit(y)
    level = y[0]
    for v in y[1:]:
        level = 0.94 * level + 0.06 * v
    assert ewma.name == "ewma_0.94" and ewma.forecast(1)[0] == pytest.approx(level)
    mean = forecasters.HistoricalMean(20)
    mean.fit(y)
    assert mean.name == "historical_mean_20" and mean.forecast(1)[0] == pytest.approx(y[-20:].mean())
    har = forecasters.HAR()
    har.fit(y[:40])
    with pytest.raises(forecasters.NotEnoughData):
        har.forecast(1)
    with pytest.raises(NotImplementedError):
        forecasters.AMEM().fit(y)
    with pytest.raises(forecasters.NotEnoughData):
        forecasters.HARJ().fit(y)
    with pytest.raises(ValueError, match="past the origin"):
        forecasters.HAR().fit(y[:50], {"jump": y})
    jump = forecasters.HARJ()
    jump.fit(vol_series(300), {"jump": np.full(300, 0.0)})
    jump.forecast(1)
    jump.x[-1] *= 1e6
    assert jump.forecast(1)[0] == pytest.approx(vol_series(300).mean()) and jump.insane == 1
    fake = forecasters.Foundation(lambda y, past, future, h, levels: np.outer(np.arange(1, h + 1), np.array(levels)) * y[-1], past=("vix",))
    fake.fit(y, {"vix": np.where(np.arange(60) % 2, np.nan, 1.0)})
    assert fake.forecast(2)[0] == pytest.approx(y[-1])
    assert forecasters.load_pipeline("m", "cpu", lambda c, d: object()) is forecasters.load_pipeline("m", "cpu", lambda c, d: object())
    forecasters.clear_pipelines()


def test_backtest_blocks_change_nothing(spark):
    rows = vol_frame(spark, 200)
    config = backtest.BacktestConfig(horizons=(1, 5), min_train=100, refit_frequency=7, scheme="rolling")
    models = {"har": forecasters.HAR, "random_walk": forecasters.RandomWalk, "historical_mean": forecasters.HistoricalMean}
    order = ["model", "ticker", "origin_date", "horizon"]
    whole = backtest.run_backtest(rows, "y", models, config).drop("seconds").toPandas().sort_values(order).reset_index(drop=True)
    split = backtest.run_backtest(rows, "y", models, config, origins_per_task=20).drop("seconds").toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, split)
    for name in ("random_walk", "historical_mean"):
        native = backtest.naive_backtest(rows, "y", config, name).toPandas().sort_values(order).reset_index(drop=True)
        kernel = whole[whole["model"] == name].reset_index(drop=True)[list(native.columns)]
        pd.testing.assert_frame_equal(native, kernel, check_dtype=False, rtol=1e-10)
    raw = backtest.run_backtest(rows, "y", models, config)
    d = backtest.diagnostics(raw).where("model = 'har' and ticker = 'A'").first()
    assert d.origins == 100 and d.failed_fits == 0
    assert backtest.models_of(backtest.results(raw)) == ["har", "historical_mean", "random_walk"]
    q = backtest.random_walk_quantiles(rows, "y", config, 5, (0.05, 0.5)).toPandas().sort_values(["ticker", "origin_date"])
    k = whole[(whole["model"] == "random_walk") & (whole["horizon"] == 5)].sort_values(["ticker", "origin_date"])
    both = q.merge(k, on=["ticker", "origin_date"])
    np.testing.assert_allclose(both["q0_05"], both["q0.05"], rtol=1e-10)


def test_backtest_bounds(spark):
    rows = vol_frame(spark, 150, ("A",))
    config = backtest.BacktestConfig(horizons=(1,), min_train=60, start=date(2015, 5, 1), end=date(2015, 6, 30), max_origins=10, target="average")
    native = backtest.naive_backtest(rows, "y", config, "random_walk").orderBy("origin_date").collect()
    kernel = backtest.run_backtest(rows, "y", {"random_walk": forecasters.RandomWalk}, config).orderBy("origin_date").collect()
    assert [r.origin_date for r in native] == [r.origin_date for r in kernel] and len(native) == 10
    assert [r.realized for r in native] == pytest.approx([r.realized for r in kernel])
    for bad in ({"horizons": ()}, {"scheme": "x"}, {"target": "x"}, {"refit_frequency": 0}):
        with pytest.raises(ValueError):
            backtest.BacktestConfig(**bad)
    with pytest.raises(TypeError):
        backtest.run_backtest(rows, "y", {"x": 3}, config)


def test_scores(spark):
    rows = [("m", "T", date(2020, 1, k + 1), date(2020, 1, k + 2), 1, f, r, q) for k, (f, r, q) in enumerate([(1.0, 1.0, 2.0), (-1.0, 1.0, 0.5), (float("nan"), 1.0, None), (2.0, 4.0, 3.0)])]
    table = spark.createDataFrame(rows, "model string, ticker string, origin_date date, target_date date, horizon int, forecast double, realized double, `q0.5` double")
    scored = scores.add_losses(table).orderBy("origin_date").collect()
    assert [r.qlike for r in scored] == [0.0, None, None, pytest.approx(4 - math.log(4) - 1)]
    total = scores.aggregate(scores.add_losses(table), ("model", "horizon")).first()
    assert (total.n_obs, total.n_failed) == (3, 1) and total.rmse == pytest.approx(math.sqrt((0 + 4 + 4) / 3))
    c = scores.coverage(table).first()
    assert (c.level, c.coverage, c.n_obs) == (0.5, pytest.approx(1 / 3), 3)
    assert scores.parse_quantile_column(scores.quantile_column(0.05)) == 0.05 and scores.parse_quantile_column("qlike") is None
    few = scores.mincer_zarnowitz(table.limit(2)).first()
    assert few.alpha is None and few.r2 is None
    with pytest.raises(KeyError):
        scores.add_losses(table.drop("realized"))


def test_significance(spark):
    assert distributions.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert distributions.t_two_sided(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)
    assert distributions.normal_cdf(1.6448536) == pytest.approx(0.95)
    rng = np.random.default_rng(0)
    losses = np.column_stack([rng.normal(1.0, 0.2, 300), rng.normal(1.01, 0.2, 300), rng.normal(2.0, 0.2, 300)])
    table = significance.confidence_set(losses, ["a", "b", "c"], draws=300).set_index("model")
    assert table.loc["a", "included"] and not table.loc["c", "included"] and table.loc["c", "mcs_p"] < 0.1
    assert significance.confidence_set(losses[:5], ["a", "b", "c"])["included"].all()
    days = pd.bdate_range("2020-01-01", periods=300).date
    frame = pd.concat([pd.DataFrame({"model": m, "ticker": "T", "origin_date": days, "horizon": 1, "qlike": losses[:, k]}) for k, m in enumerate("abc")])
    dm = {r.model: r for r in significance.dm_against_benchmark(spark.createDataFrame(frame), "a", 1).collect()}
    d = losses[:, 2] - losses[:, 0]
    want = d.mean() / math.sqrt(d.var() / 300) * math.sqrt((300 + 1 - 2) / 300)
    assert dm["c"].dm_stat == pytest.approx(want) and dm["c"].verdict == "worse" and dm["b"].verdict in ("equal", "worse")
    same = pd.concat([frame[frame["model"] == "a"], frame[frame["model"] == "a"].assign(model="z")])
    z = significance.dm_against_benchmark(spark.createDataFrame(same), "a", 1).first()
    assert (z.dm_stat, z.p_value, z.verdict) == (0.0, 1.0, "equal")


def test_sets_added_up_in_spark_are_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2020-01-01", periods=83).date
    frame = pd.concat([pd.DataFrame({"model": m, "ticker": t, "origin_date": days[: 83 - 20 * k], "horizon": 3, "qlike": rng.normal(1 + 0.3 * (m == "c"), 0.4, 83 - 20 * k)}) for k, t in enumerate("PQR") for m in "abc"])
    table = spark.createDataFrame(frame)
    for per_ticker in (False, True):
        got = {(r.ticker, r.model): r for r in significance.model_confidence_sets(table, 3, draws=60, seed=5, per_ticker=per_ticker).collect()}
        parts = [(t, own) for t, own in frame.groupby("ticker")] if per_ticker else [(None, frame)]
        assert len(got) == 3 * len(parts)
        for k, (ticker, own) in enumerate(parts):
            wide = own.pivot(index=["ticker", "origin_date"], columns="model", values="qlike").sort_index()
            want = significance.confidence_set(wide.to_numpy(), list("abc"), draws=60, block=3, seed=5 + k)
            for w in want.itertuples():
                r = got[ticker, w.model]
                assert (r.mean_loss, r.mcs_p) == pytest.approx((w.mean_loss, w.mcs_p)) and (r.included, r.n_obs) == (w.included, w.n_obs)
                assert r.eliminated_at == (None if pd.isna(w.eliminated_at) else w.eliminated_at)


def test_lags_run_over_the_bounds_of_tickers(spark):
    rng = np.random.default_rng(6)
    sizes = {"P": 30, "Q": 2, "R": 1, "S": 40}
    frame = pd.concat([pd.DataFrame({"ticker": t, "model": m, "origin_date": pd.bdate_range("2020-01-01", periods=n).date, "d": rng.normal(0.1, 1, n)}) for t, n in sizes.items() for m in "ab"])
    for horizon in (1, 2, 5):
        got = {r.model: r for r in significance.hac_variance(spark.createDataFrame(frame), ("model",), horizon).collect()}
        for m in "ab":
            d = frame[frame["model"] == m].sort_values(["ticker", "origin_date"])["d"].to_numpy()
            e, n = d - d.mean(), len(d)
            long = e @ e / n + sum(2 * (1 - k / horizon) * (e[k:] @ e[:-k]) / n for k in range(1, horizon))
            assert got[m].variance == pytest.approx((long if long > 0 else e @ e / n) / n) and got[m].n == n


def test_published(spark):
    assert len(published.EQUITIES) == 40 and published.reference_table(spark, "qlike").count() == 51
    with pytest.raises(ValueError):
        published.reference_table(spark, "x")
    ours = spark.createDataFrame([("log_har", 1, 0.2, 1.0), ("random_walk", 1, 0.3, 1.1)], "model string, horizon int, qlike double, qlike_ratio double")
    got = {r.model: r for r in published.at_horizon(published.compare(ours, ours), 1).collect()}
    assert got["log_har"].ratio_diff == 0.0 and got["random_walk"].published_ratio is None


def test_options():
    assert options.black76(100, 100, 1.0, 0.0, 0.2, True) == pytest.approx(7.965567, abs=1e-5)
    f, k, t, r = 100.0, np.array([80.0, 100.0, 130.0]), 0.5, 0.03
    call, put = options.black76(f, k, t, r, 0.3, True), options.black76(f, k, t, r, 0.3, False)
    np.testing.assert_allclose(call - put, math.exp(-r * t) * (f - k))
    np.testing.assert_allclose(options.implied_vol(call, f, k, t, r, True), 0.3, rtol=1e-6)
    assert np.isnan(options.implied_vol(-1.0, f, 100.0, t, r, True)) and options.black76(f, 80.0, 0.0, r, 0.3, True) == 20


def test_chain(spark):
    rows = []
    asof = pd.Timestamp("2026-10-01 19:07")
    for days in (3, 10, 24, 38, 66):
        expiry = date(2026, 10, 1) + timedelta(days)
        years = (pd.Timestamp(expiry) + pd.Timedelta(hours=20 if expiry < date(2026, 11, 1) else 21) - asof).total_seconds() / (365 * 86400)
        for strike in np.arange(140, 262.5, 2.5):
            for kind in ("call", "put"):
                price = float(options.black76(200 * math.exp(0.04 * years), strike, years, 0.04, 0.25, kind == "call"))
                rows.append(("X", asof.to_pydatetime(), expiry, kind, float(strike), price, price, 0.25))
    chain = spark.createDataFrame(rows, "ticker string, asof timestamp, expiry date, type string, strike double, bid double, ask double, impliedVolatility double")
    row, tidy = smiles.summarize_chain(chain, 200.0)
    found = row.first()
    assert found.iv30 == pytest.approx(0.25, abs=1e-5) and found.iv30_yahoo == pytest.approx(0.25) and found.iv30_flag == "ok" and abs(found.skew) < 1e-4
    assert tidy.count() == len(rows)


# sources and streams


def measures(n, seed):
    rv = vol_series(n, seed) ** 2
    return pd.DataFrame({"date": pd.bdate_range("2019-01-01", periods=n).strftime("%Y-%m-%d"), "rv5": rv, "bv5": rv * 0.9, "close_price": 10.0})


def test_archive_layouts(spark, tmp_path):
    nested = tmp_path / "nested" / "stocks" / "aaa"
    nested.mkdir(parents=True)
    frame = measures(30, 1)
    for k, row in frame.iterrows():
        frame.loc[[k]].drop(columns="date").to_parquet(nested / f"{row['date'].replace('-', '_')}.parquet")
    files = tmp_path / "files"
    files.mkdir()
    measures(40, 2).to_csv(files / "bbb.csv", index=False)
    measures(20, 3).to_parquet(files / "ccc.parquet")
    combined = tmp_path / "combined"
    combined.mkdir()
    pd.concat([measures(30, 4).assign(symbol="x"), measures(30, 5).assign(symbol="Y")]).to_parquet(combined / "all.parquet")
    assert set(archive.discover(spark, str(tmp_path / "nested"))) == {"AAA"}
    assert set(archive.discover(spark, str(files))) == {"BBB", "CCC"}
    assert set(archive.discover(spark, str(combined))) == {archive.COMBINED}
    for root, want in ((tmp_path / "nested", {"AAA": 30}), (files, {"BBB": 40}), (combined, {"X": 30, "Y": 30})):
        rows, report = archive.build_archive(spark, archive.ArchiveConfig(root=str(root), min_observations=25))
        assert {r["ticker"]: r["count"] for r in rows.groupBy("ticker").count().collect()} == want
        assert report.where("skipped").count() == (1 if root == files else 0)
    one = rows.where("ticker = 'X'").orderBy("date").first()
    assert one.rv_rv5 == pytest.approx(math.sqrt(one.var_rv5)) and one.jump == pytest.approx(one.var_rv5 * 0.1)
    assert "rk" in archive.missing_measures(rows.columns)
    with pytest.raises(FileNotFoundError):
        archive.discover(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        archive.ArchiveConfig(root="x", measure="nope")


def test_archive_files_are_read_by_their_own_headers(spark, tmp_path):
    root = tmp_path / "vol"
    (root / "vol").mkdir(parents=True)
    (root / "AAA.csv").write_text("date,rv5,close\n2020-01-02,0.02,50\n2020-01-03,0.03,51\n")
    (root / "BBB.csv").write_text("date,close,realized_variance_5min\n2020-01-02,70,0.04\n2020-01-02,71,0.05\n")
    (root / "vol" / "x.csv").write_text("Date,RV5\n2020-01-06,0.06\n")
    pd.DataFrame({"DATE": ["2020-01-02"], "RV_5": [0.07]}).to_parquet(root / "CCC.parquet")
    (root / "DDD.parquet").write_bytes(b"no parquet at all")
    before = spark.conf.get("spark.sql.files.ignoreCorruptFiles")
    config = archive.ArchiveConfig(root=str(root), min_observations=1, symbols=("AAA", "bbb", "CCC", "DDD", "VOL", "EEE"))
    rows, report = archive.build_archive(spark, config)
    got = sorted((r.ticker, str(r.date), r.var_rv5) for r in rows.collect())
    assert got == [("AAA", "2020-01-02", 0.02), ("AAA", "2020-01-03", 0.03), ("BBB", "2020-01-02", 0.05), ("CCC", "2020-01-02", 0.07), ("VOL", "2020-01-06", 0.06)]
    found = {r.ticker: (r.files, r.files_read, r["rows"], r.found) for r in report.collect()}
    assert found["DDD"] == (1, 0, 0, False) and found["EEE"] == (0, 0, 0, False) and found["BBB"] == (1, 1, 1, True)
    assert spark.conf.get("spark.sql.files.ignoreCorruptFiles") == before
    told = archive.manifest(rows, report, config)
    assert told["not_found"] == ["DDD", "EEE"] and told["config"]["measure"] == "rv5" and "rk" in told["missing_measures"]


def test_bars_must_be_bars(spark):
    good = spark.createDataFrame(walk(3))
    assert cleaning.require_ohlc(good) is good
    for bad in (good.drop("low"), good.withColumn("date", F.lit("x")), good.withColumn("close", F.lit("1"))):
        with pytest.raises(ValueError):
            cleaning.require_ohlc(bad)


def test_the_last_row_of_a_date_stays(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ticker,date,open,high,low,close,volume\nT,2020-01-02,9,9.5,8,9,1\nT,2020-01-02,1,2,0.5,1.5,1\n")
    clean, report = daily.load_bars(daily.read_any(spark, str(tmp_path / "b.csv")))
    assert [r.close for r in clean.collect()] == [1.5] and report.first().dropped == 1


def test_companions(spark):
    days = [date(2020, 1, k) for k in (1, 2, 3)]
    rows = spark.createDataFrame([("A", days[0], 1.0), ("A", days[1], 2.0), ("B", days[1], 5.0), ("C", days[2], 7.0)], "ticker string, date date, y double")
    got = {(r.ticker, r.date.day): (r.companion_A, r.companion_B) for r in covariates.companions(rows, "y", ("A", "B")).collect()}
    assert got == {("A", 1): (None, None), ("A", 2): (None, 5.0), ("B", 2): (2.0, None), ("C", 3): (None, None)}
    seen = []
    model = forecasters.Foundation(lambda y, past, future, h, levels: seen.append((past, np.random.rand())) or np.ones((h, len(levels))), companions=("companion_A", "companion_B"), seed=3)
    y = np.ones(10)
    for _ in range(2):
        model.fit(y, {"companion_A": np.where(np.arange(10) < 6, np.nan, 2.0), "companion_B": np.where(np.arange(10) < 4, np.nan, 3.0)})
    assert set(seen[0][0]) == {"companion_B"} and (seen[0][0]["companion_B"] == 3.0).all() and seen[0][1] == seen[1][1]
    assert forecasters.resolve_device("x") == "x" and forecasters.resolve_device() in ("cpu", "cuda")


def test_models_may_be_instances(spark):
    rows = vol_frame(spark, 130, ("A",))
    config = backtest.BacktestConfig(horizons=(1,), min_train=120)
    made = forecasters.EWMA(0.9)
    a, b = (backtest.results(backtest.run_backtest(rows, "y", {"m": m}, config)).orderBy("origin_date").collect() for m in (made, lambda: forecasters.EWMA(0.9)))
    assert a == b and len(a) == 10 and not len(made.y)


def test_decayed_sums():
    x = np.random.default_rng(2).normal(size=333)
    for decay in (0.0, 0.94, -0.5, 0.999999):
        want, now = [], 0.0
        for v in x:
            now = v + decay * now
            want.append(now)
        np.testing.assert_allclose(forecasters.decayed_sums(x, decay), want, rtol=1e-9, atol=1e-12)


def test_daily_sources(spark, tmp_path):
    walk(20).to_csv(tmp_path / "bars.csv", index=False)
    raw = daily.read_any(spark, str(tmp_path / "bars.csv"))
    clean, report = daily.load_bars(raw, start="2015-01-05", end="2015-01-12")
    assert clean.count() == 5 and report.count() == 0
    assert daily.close_series(clean, "T").columns == ["date", "close"]
    with pytest.raises(ValueError):
        daily.read_any(spark, "x.xml")
    calls = []
    assert daily.retry(lambda: calls.append(1) or 1 / 0, sleep=lambda s: calls.append(s)) is None and calls == [1, 1.5, 1, 3.0, 1]
    assert daily.release_dates(None, spark).count() == 0 and daily.intraday_bars(None) is None


def test_iv_bank(spark, tmp_path):
    chunks = ivbank.year_chunks(date(2020, 1, 1), date(2024, 2, 29), 2)
    assert [c.date() for c, _ in chunks] == [date(2024, 2, 29), date(2022, 3, 7), date(2020, 3, 14)]
    assert ivbank.year_chunks(date(2024, 1, 2), date(2024, 1, 1), 1) == [] and ivbank.contract_of("^VIX") == ("VIX", "index")

    class Fake:
        def bars(self, contract, what, end, duration):
            return [(date(2026, 1, 5), 0.2, 0.3, 0.1, 0.25), (date(2026, 1, 6), 0.2, 0.3, 0.1, 0.123456789)] if contract[0] != "BAD" else 1 / 0

        def earliest(self, contract, what):
            return date(2015, 1, 2)

    found = ivbank.fetch_range(spark, Fake(), "AAA", date(2026, 1, 1), date(2026, 1, 5)).collect()
    assert [(r.iv, r.hv) for r in found] == [(0.25, 0.25)]
    waits, asked = [], []

    class Slow(Fake):
        def bars(self, contract, what, end, duration):
            asked.append(end)
            if len(asked) == 1:
                raise ivbank.GatewayError(2104, "all is well")
            return [(date(2026, 1, 5), 0.2, 0.3, 0.1, 0.25)] if len(asked) < 4 else []

    ivbank.fetch_range(spark, Slow(), "AAA", date(2020, 1, 1), date(2026, 1, 5), pause=2.5, sleep=waits.append)
    assert asked[0] == asked[1] and waits == [2.5, 2.5]
    with pytest.raises(ivbank.GatewayError):
        ivbank.request(type("Bad", (), {"bars": lambda *a: (_ for _ in ()).throw(ivbank.GatewayError(162))})(), "A", "x", None, "")
    path = str(tmp_path / "bank")
    for _ in range(2):
        assert ivbank.main(["update", "--out", path, "--tickers", "AAA", "BBB"], spark, lambda a: Fake(), (), date(2026, 1, 7)) == 0
    rows = spark.read.csv(path, header=True, schema=ivbank.SCHEMA).collect()
    assert len(rows) == 4 and {r.iv for r in rows} == {0.25, 0.123457}
    assert ivbank.main(["head", "--out", path + "2", "--tickers", "AAA"], spark, lambda a: Fake(), ()) == 0
    assert ivbank.main(["head"], spark, lambda a: None, ("A",)) == 2


def test_streams(spark, tmp_path):
    from emberpanel.streaming import bars

    ticks = spark.createDataFrame([("T", pd.Timestamp(f"2024-01-0{d} 10:0{k}").to_pydatetime(), p, 1.0) for d, k, p in ((1, 0, 5.0), (1, 1, 7.0), (1, 2, 6.0), (2, 0, 8.0), (5, 0, 9.0))], "ticker string, ts timestamp, price double, size double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    for name, frame, mode in (("bars", bars.daily_bars(stream), "complete"), ("levels", bars.ewma_state(stream.select("ticker", F.to_date("ts").alias("date"), F.col("price").alias("y"))), "append")):
        run = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    first = spark.table("bars").orderBy("date").first()
    assert (first.open, first.high, first.low, first.close, first.volume) == (5.0, 7.0, 5.0, 6.0, 3.0)
    levels = sorted(r.level for r in spark.table("levels").collect())
    assert len(levels) == 5 and levels[0] == 5.0


def test_command_lines(spark, tmp_path):
    from emberpanel import cli

    bars = pd.concat([walk(150, k).assign(ticker=t) for k, t in enumerate("AB")])
    bars.to_csv(tmp_path / "bars.csv", index=False)
    out = str(tmp_path / "out")
    assert cli.main(["panel", "--bars", str(tmp_path / "bars.csv"), "--window", "5", "--output-dir", out, "--quiet"], spark) == 0
    assert spark.read.parquet(f"{out}/panel").select("ticker").distinct().count() == 2
    assert cli.main(["backtest", "--input-dir", f"{out}/panel", "--horizons", "1", "--min-train", "120", "--refit", "20", "--bootstrap", "50", "--output-dir", f"{out}/bt"], spark) == 0
    assert spark.read.csv(f"{out}/bt/leaderboard_1", header=True).count() == 5
    root = tmp_path / "archive"
    root.mkdir()
    measures(330, 2).to_csv(root / "bbb.csv", index=False)
    args = ["replicate", "--archive-root", str(root), "--start", "2019-01-01", "--end", "2030-01-01", "--window-size", "300", "--refit", "30", "--horizons", "1", "--no-slow-models", "--no-mem", "--bootstrap", "20", "--output-dir", f"{out}/rep"]
    assert cli.main(args, spark) == 0
    assert spark.read.csv(f"{out}/rep/comparison", header=True).where("model = 'log_har'").first().published_ratio == "1.0"


def test_mem_backtest_refits_at_every_origin(spark, monkeypatch):
    some = queries.vol_panel_of(spark, "/root/testdata/sf0.001").where("ticker = 'A' and rv_gk is not null").orderBy("date").limit(530)
    monkeypatch.setattr(queries, "vol_panel_of", lambda spark, sf_dir: some)
    got = queries.QUERIES["mem_backtest"](spark, "").where("horizon = 1").toPandas().sort_values("origin_date")
    y = backtest.series(some, "rv_gk").toPandas().sort_values("pos")["y"].to_numpy(float)
    for k in (1, len(got) - 1):
        model = forecasters.MEM()
        p = 499 + k
        model.fit(y[max(0, p + 1 - queries.KERNEL.window) : p + 1], {})
        assert got["forecast"].iloc[k] == pytest.approx(model.forecast(1)[0], abs=2e-8)
