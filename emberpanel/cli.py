"""Command lines: ``panel`` builds a volatility panel, ``backtest`` scores models on it, ``replicate`` runs the published protocol on an archive."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberpanel.functions.variance import DEFAULT_ESTIMATORS, SUFFIXES
from emberpanel.operators import diagnostics, published, scores, significance
from emberpanel.operators.covariates import TAGS, align, earnings_countdown
from emberpanel.plans import backtest, forecasters, panel
from emberpanel.sources import archive, daily, plots

BENCHMARK = "log_har"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="emberpanel")
    modes = top.add_subparsers(dest="mode", required=True)
    p = modes.add_parser("panel")
    p.add_argument("--bars", required=True, help="daily bars: parquet or csv")
    p.add_argument("--with-intraday", help="intraday bars")
    p.add_argument("--tickers", nargs="*", default=[])
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--window", type=int, default=21)
    p.add_argument("--annualization", type=float, default=252.0)
    p.add_argument("--estimators", nargs="*", choices=list(SUFFIXES), default=list(DEFAULT_ESTIMATORS))
    p.add_argument("--covariates", nargs="*", choices=list(TAGS), default=["vix", "volume", "earnings_flag"])
    p.add_argument("--earnings-k", type=int, default=1)
    p.add_argument("--vix", help="index bars with date and close")
    p.add_argument("--releases", help="release dates by ticker")
    p.add_argument("--csv", action="store_true")
    b = modes.add_parser("backtest")
    b.add_argument("--input-dir", required=True, help="a saved panel")
    b.add_argument("--target", default="rv_gk")
    b.add_argument("--horizons", nargs="*", type=int, default=[1, 5, 21])
    b.add_argument("--min-train", type=int, default=250)
    b.add_argument("--window", choices=("expanding", "rolling"), default="expanding")
    b.add_argument("--rolling-size", type=int)
    b.add_argument("--refit", type=int, default=5)
    b.add_argument("--with-mem", action="store_true")
    b.add_argument("--plot-ticker")
    b.add_argument("--plot-horizon", type=int, default=21)
    r = modes.add_parser("replicate")
    r.add_argument("--archive-root")
    r.add_argument("--input-dir")
    r.add_argument("--assets", nargs="*", default=[])
    r.add_argument("--max-assets", type=int)
    r.add_argument("--measure", default="rv5")
    r.add_argument("--start", default=published.SAMPLE[0])
    r.add_argument("--end", default=published.SAMPLE[1])
    r.add_argument("--track", choices=("point", "aggregate"), default="point")
    r.add_argument("--horizons", nargs="*", type=int, default=list(published.HORIZONS))
    r.add_argument("--window-size", type=int, default=published.WINDOW)
    r.add_argument("--refit", type=int, default=1)
    r.add_argument("--no-exog-models", action="store_true")
    r.add_argument("--no-slow-models", action="store_true")
    r.add_argument("--no-mem", action="store_true")
    r.add_argument("--with-naive", action="store_true")
    r.add_argument("--max-origins", type=int)
    r.add_argument("--vix", help="index bars with date and close, for models with covariates")
    r.add_argument("--releases", help="release dates by ticker, likewise")
    r.add_argument("--ingest-only", action="store_true")
    for q, draws in ((p, None), (b, 1000), (r, 500)):
        if draws:
            q.add_argument("--bootstrap", type=int, default=draws)
        q.add_argument("--output-dir", required=True)
        q.add_argument("--quiet", action="store_true")
    return top


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, default=str, indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def report(spark: SparkSession, raw: DataFrame, config: backtest.BacktestConfig, out: str, draws: int, compare: bool = False, quiet: bool = True) -> dict:
    """Save scored results, diagnostics and every summary table; the paths by name."""
    raw.write.mode("overwrite").parquet(f"{out}/raw")
    raw = spark.read.parquet(f"{out}/raw")
    scored = scores.add_losses(backtest.results(raw))
    scored.write.mode("overwrite").parquet(f"{out}/results")
    models = backtest.models_of(raw)
    benchmark = BENCHMARK if BENCHMARK in models else models[0]
    tables = scores.summarize(scored, benchmark)
    covered = scores.coverage(scored)
    tables |= {"coverage_by_level": scores.coverage_pivot(covered)}
    tables |= {"diagnostics": backtest.diagnostics(raw), "coverage": covered, "mincer_zarnowitz": scores.mincer_zarnowitz(scored), "subsamples": scores.subsamples(scored, benchmark)}
    for h in config.horizons:
        tables |= {
            f"leaderboard_{h}": scores.leaderboard(tables["equal_weighted"], h),
            f"dm_{h}": significance.dm_against_benchmark(scored, benchmark, h),
            f"dm_verdicts_{h}": significance.verdict_table(significance.dm_against_benchmark(scored, benchmark, h, per_ticker=True)),
            f"mcs_{h}": significance.model_confidence_sets(scored, h, draws=draws),
        }
        rates = significance.inclusion_rates(significance.model_confidence_sets(scored, h, draws=draws, per_ticker=True))
        tables[f"mcs_inclusion_{h}"] = published.with_inclusion(rates, h) if compare else rates
    if compare:
        tables["comparison"] = published.compare(tables["equal_weighted"], tables["pooled"], tables["mincer_zarnowitz"])
        tables["ratio_by_horizon"] = published.ratio_pivot(tables["comparison"], config.horizons)
        tables["agreement"] = published.agreement(tables["comparison"])
    for name, table in tables.items():
        save_csv(table, f"{out}/{name}")
    if not quiet:
        for name in ("coverage_by_level", "ratio_by_horizon"):
            if name in tables:
                tables[name].orderBy(*tables[name].columns[:2]).show(1000, truncate=False)
    return {name: f"{out}/{name}" for name in ("results", *tables)}


def run_panel(spark: SparkSession, args: argparse.Namespace) -> int:
    read = lambda path: daily.read_any(spark, path) if path else None
    bars, dropped = daily.load_bars(read(args.bars), tickers=args.tickers, start=args.start, end=args.end)
    config = panel.PanelConfig(tickers=tuple(args.tickers), start=args.start, end=args.end, rv_window=args.window, annualization_factor=args.annualization, estimators=tuple(args.estimators), covariates=tuple(args.covariates), earnings_window_days=args.earnings_k)
    vix = read(args.vix)
    vix = vix.select(F.to_date("date").alias("date"), F.col("close").cast("double").alias("close")) if vix is not None else None
    releases = daily.release_dates(read(args.releases), spark) if args.releases else None
    out = panel.build_panel(bars, config, intraday=daily.intraday_bars(read(args.with_intraday)), vix=vix, releases=releases)
    found = panel.save(out, config, args.output_dir, args.csv)
    saved = spark.read.parquet(f"{args.output_dir}/panel")
    for name, table in (("dropped", dropped.withColumn("dates", F.array_join(F.transform("dates", lambda d: d.cast("string")), " "))), ("correlations", diagnostics.correlations(saved)), ("noise", diagnostics.noise_ranking(saved))):
        save_csv(table, f"{args.output_dir}/{name}")
    if not args.quiet:
        print(json.dumps(found["tickers"], default=str))
    return 0 if found["tickers"] else 1


def run_backtests(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = archive.load_series(spark, args.input_dir, args.target)
    config = backtest.BacktestConfig(horizons=tuple(args.horizons), scheme=args.window, min_train=args.min_train, rolling_size=args.rolling_size, refit_frequency=args.refit)
    raw = backtest.run_backtest(rows, args.target, forecasters.baseline_models(args.with_mem), config)
    saved = report(spark, raw, config, args.output_dir, args.bootstrap, quiet=args.quiet)
    if args.plot_ticker:
        plots.draw(plots.fan(spark.read.parquet(saved["results"]), BENCHMARK, args.plot_ticker, args.plot_horizon), f"{args.output_dir}/fan.png", "target_date", "quantile", "level")
    save_json(spark, f"{args.output_dir}/manifest.json", {"arguments": vars(args), "tables": saved})
    return 0


def config_of(args: argparse.Namespace) -> archive.ArchiveConfig:
    return archive.ArchiveConfig(root=args.archive_root, symbols=tuple(args.assets), measure=args.measure, start=args.start, end=args.end)


def run_replication(spark: SparkSession, args: argparse.Namespace) -> int:
    source = args.input_dir
    if args.archive_root:
        rows, dropped = archive.build_archive(spark, config_of(args))
        source = f"{args.output_dir}/archive"
        rows.write.mode("overwrite").partitionBy("ticker").parquet(source)
        save_csv(dropped, f"{args.output_dir}/dropped")
        save_json(spark, f"{args.output_dir}/archive_manifest.json", archive.manifest(spark.read.parquet(source), dropped, config_of(args)))
    if args.ingest_only:
        return 0
    exog = () if args.no_exog_models else ("jump", "var_rsp", "var_rsn", "var_rq")
    value = f"rv_{args.measure}"
    rows = archive.load_series(spark, source, value, exog, args.max_assets)
    vix = daily.read_any(spark, args.vix).select(F.to_date("date").alias("date"), F.col("close").cast("double").alias("close")) if args.vix else None
    rows = foundation_covariates(rows, vix, daily.release_dates(daily.read_any(spark, args.releases), spark) if args.releases else None)
    there = tuple(c for c in (*exog, "vix", "days_to_earnings") if c in rows.columns)
    config = backtest.BacktestConfig(horizons=tuple(args.horizons), scheme="rolling", min_train=args.window_size, refit_frequency=args.refit, max_origins=args.max_origins, target="average" if args.track == "aggregate" else "point")
    models = forecasters.published_models(exog=bool(there), slow=not args.no_slow_models, mem=not args.no_mem, naive=args.with_naive)
    raw = backtest.run_backtest(rows, value, models, config, there, origins_per_task=250)
    saved = report(spark, raw, config, args.output_dir, args.bootstrap, compare=args.track == "point", quiet=args.quiet)
    save_json(spark, f"{args.output_dir}/manifest.json", {"arguments": vars(args), "models": list(models), "exog": there, "tables": saved})
    return 0


def foundation_covariates(rows: DataFrame, vix: DataFrame | None, releases: DataFrame | None) -> DataFrame:
    """The index close and the sessions to the next release on every row, for models with covariates; a missing source is left out."""
    if vix is not None:
        rows = align(rows, vix, "close", "vix")
    return rows if releases is None else earnings_countdown(rows, releases)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"panel": run_panel, "backtest": run_backtests, "replicate": run_replication}[args.mode](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
