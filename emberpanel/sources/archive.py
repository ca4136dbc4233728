"""Archives of realized measures in four layouts, read as one panel.

Symbol folders of daily files, the same within class folders, a file a symbol, or one file of all symbols. Listing and schema
probing happen on the driver; rows are read, deduplicated and filtered in one plan.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberpanel.operators.cleaning import normalize_date, realized_schema
from emberpanel.sources.daily import read_any

# The archive's column names by measure in order of preference, its dates and symbols, and which measures are variances.
MEASURES = {
    "rv5": ("rv5", "RV5", "rv_5", "rv5min", "realized_variance_5min"),
    "rv5_ss": ("rv5_ss", "RV5_SS", "rv5ss"),
    "rv1": ("rv1", "RV1"),
    "bv": ("bv5", "bv", "BV5", "bpv5", "bipower_variation"),
    "rq": ("rq5", "rq", "RQ5", "realized_quarticity"),
    "rsp": ("rsp5", "rsp", "RSP5", "rs_plus", "realized_semivariance_positive"),
    "rsn": ("rsn5", "rsn", "RSN5", "rs_minus", "realized_semivariance_negative"),
    "medrv": ("medrv5", "medrv", "MEDRV5"),
    "minrv": ("minrv5", "minrv", "MINRV5"),
    "rk": ("rk", "RK", "realized_kernel", "rk_parzen"),
    "rr5": ("rr5", "RR5", "realized_range"),
    "pr": ("pr", "PR", "parkinson_range"),
    "gkr": ("gkr", "GKR", "garman_klass_range"),
    "open": ("open_price", "open", "Open", "OPEN"),
    "high": ("high_price", "high", "High", "HIGH"),
    "low": ("low_price", "low", "Low", "LOW"),
    "close": ("close_price", "close", "Close", "CLOSE"),
    "volume": ("volume", "Volume", "VOLUME"),
    "trades": ("trades", "Trades", "n_trades"),
}
DATES = ("date", "Date", "DATE", "datetime", "timestamp", "day", "dt")
SYMBOLS = ("symbol", "Symbol", "SYMBOL", "ticker", "Ticker", "asset", "id")
VARIANCES = ("rv5", "rv5_ss", "rv1", "bv", "rsp", "rsn", "medrv", "minrv", "rk", "rr5", "pr", "gkr")
VOLATILITIES = ("rv5", "rv5_ss", "bv", "medrv", "rk", "pr", "gkr")
DATE_IN_NAME = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})"
ENDINGS = (".parquet", ".pq", ".csv")
COMBINED = "__COMBINED__"


@dataclass(frozen=True)
class ArchiveConfig:
    root: str
    symbols: tuple[str, ...] = ()
    measure: str = "rv5"
    start: str | None = None
    end: str | None = None
    annualization_factor: float = 1.0
    min_observations: int = 250

    def __post_init__(self) -> None:
        if self.measure not in VARIANCES:
            raise ValueError(f"measure must be one of {VARIANCES}")
        if self.annualization_factor <= 0:
            raise ValueError("annualization_factor must be positive")


def resolve(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first name that is a column, exactly or else in any case."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((n for n in names if n in columns), None) or next((low[n.lower()] for n in names if n.lower() in low), None)


def list_files(spark: SparkSession, root: str) -> tuple[str, list[str]]:
    """(the root's full path, paths below it), through Spark's file systems, so that remote stores work."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"archive root does not exist: {root}")
    base, out, found = str(fs.getFileStatus(path).getPath()).rstrip("/"), [], fs.listFiles(path, True)
    while found.hasNext():
        out.append(str(found.next().getPath()))
    return base, sorted(p for p in out if p.startswith(base))


def discover(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Files by upper-case symbol, or under one mark for a file of all symbols."""
    base, files = list_files(spark, root)
    found: dict[str, list[str]] = {}
    for f in files:
        if not f.lower().endswith(ENDINGS):
            continue
        folder, name = f.rsplit("/", 1)
        stem = name.rsplit(".", 1)[0].upper()
        if folder != base:
            found.setdefault(folder.rsplit("/", 1)[-1].upper(), []).append(f)
        elif not re.fullmatch(DATE_IN_NAME, stem):
            found.setdefault(stem, []).append(f)
    if not found:
        raise FileNotFoundError(f"no parquet or csv files of assets under {root}")
    if len(found) == 1 and len(only := next(iter(found.values()))) == 1 and resolve(read_any(spark, only[0]).columns, SYMBOLS):
        return {COMBINED: only}
    return {k: sorted(v) for k, v in sorted(found.items())}


def _uniform(raw: DataFrame) -> DataFrame:
    """Measures by our names, the date from its column or the file's name, the file and row order.

    Files of one read may name a measure differently: the first of its names that has a value counts.
    """
    columns = raw.columns

    def named(names: tuple[str, ...], cast) -> Column | None:
        there = dict.fromkeys(c for n in names for c in (resolve(columns, (n,)),) if c)
        return F.coalesce(*[cast(c) for c in there]) if there else None

    in_name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), DATE_IN_NAME, 0), "[-_]", "")
    date = named(DATES, lambda c: normalize_date(F.col(f"`{c}`")))
    symbol = named(SYMBOLS, lambda c: F.upper(F.col(f"`{c}`").cast("string")))
    values = {m: v for m, names in MEASURES.items() if (v := named(names, lambda c: F.expr(f"try_cast(`{c}` as double)"))) is not None}
    return raw.select(
        (F.lit(None).cast("string") if symbol is None else symbol).alias("_symbol"),
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_row"),
        (F.try_to_timestamp(in_name, F.lit("yyyyMMdd")).cast("date") if date is None else date).alias("date"),
        *[v.alias(m) for m, v in values.items()],
    )


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """CSV files by their header line."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(paths).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), "value")
    found: dict[str, list[str]] = {}
    for r in lines.where("at = 0").groupBy("f").agg(F.min_by("value", "k").alias("line")).collect():
        found.setdefault(r.line, []).append(r.f)
    return found


def read_files(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """(ticker, date, measures, _file, _row) of all files: CSV files of each header by themselves, as columns go by place there; files that cannot be read give no rows."""
    every = [p for paths in files.values() for p in paths]
    tables = [p for p in every if not p.lower().endswith(".csv")]
    reads = [spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").parquet(*tables)] if tables else []
    texts = [p for p in every if p.lower().endswith(".csv")]
    if texts:
        reads += [spark.read.option("ignoreCorruptFiles", "true").csv(sorted(own), header=True, inferSchema=False) for _, own in sorted(headers(spark, texts).items())]
    out = None
    for raw in reads:
        part = _uniform(raw)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if COMBINED in files:
        return out.withColumn("ticker", F.col("_symbol")).drop("_symbol")
    owner = spark.createDataFrame([(p, s) for s, own in files.items() for p in own], "_path string, ticker string")
    return out.join(F.broadcast(owner), F.col("_file") == F.col("_path")).drop("_path", "_symbol")


def read_archive(spark: SparkSession, files: dict[str, list[str]], *, deduplicate: bool | None = None) -> DataFrame:
    """(ticker, date, measures) of all symbols; rows without a date go.

    Of a date's several rows the last file's last row stays, but for a file of all symbols, which is taken as it is unless
    ``deduplicate`` says otherwise.
    """
    out = read_files(spark, files).where("date is not null and ticker is not null")
    if deduplicate if deduplicate is not None else COMBINED not in files:
        last = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.col("_file").desc(), F.col("_row").desc()))
        out = out.withColumn("_k", last).where("_k = 1").drop("_k")
    return out.drop("_file", "_row")


def build_archive(spark: SparkSession, config: ArchiveConfig) -> tuple[DataFrame, DataFrame]:
    """(panel of assets with enough observations, report by ticker).

    The report has files and files_read (fewer where some are empty or cannot be read), rows, kept, dropped rows by reason, whether
    the asset is skipped, and whether it was found; assets asked for that the archive lacks have a row of their own.
    """
    files = discover(spark, config.root)
    wanted = sorted({s.upper() for s in config.symbols})
    if wanted and COMBINED not in files:
        files = {k: v for k, v in files.items() if k in wanted}
        if not files:
            raise ValueError("none of the requested symbols is in the archive")
    every = read_files(spark, files)
    raw = read_archive(spark, files)
    if wanted:
        raw = raw.where(F.col("ticker").isin(wanted))
    flagged = realized_schema(raw, measure=config.measure, variances=VARIANCES, volatilities=VOLATILITIES, factor=config.annualization_factor, start=config.start, end=config.end)
    kept = F.count_if(F.col("drop_reason").isNull())
    counted = flagged.groupBy("ticker").agg(F.count("*").alias("rows"), kept.alias("kept"), *[F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in ("target", "start", "end")])
    read = every.where("ticker is not null").groupBy("ticker").agg(F.countDistinct("_file").alias("files_read"))
    known = read.select("ticker", F.lit(1).cast("long").alias("files")) if COMBINED in files else spark.createDataFrame([(k, len(v)) for k, v in files.items()], "ticker string, files long")
    asked = spark.createDataFrame([(w,) for w in wanted], "ticker string")
    known = known.join(asked, "ticker", "full") if wanted else known
    report = known.join(read, "ticker", "left").join(counted, "ticker", "left").withColumn("found", F.coalesce(F.col("files_read") > 0, F.lit(False)))
    report = report.where(F.col("ticker").isin(wanted)) if wanted else report
    report = report.na.fill(0).withColumn("skipped", F.col("kept") < config.min_observations)
    good = flagged.where("drop_reason is null").drop("drop_reason").withColumn("_n", F.count("*").over(Window.partitionBy("ticker")))
    return good.where(F.col("_n") >= config.min_observations).drop("_n"), report


def manifest(panel: DataFrame, report: DataFrame, config: ArchiveConfig) -> dict:
    """Provenance of a dataset: configuration, columns, missing measures, the report of each asset, and those asked for but not found."""
    rows = [r.asDict() for r in report.orderBy("ticker").toLocalIterator()]
    return {"config": asdict(config), "columns": panel.columns, "missing_measures": missing_measures(panel.columns), "assets": rows, "not_found": [r["ticker"] for r in rows if not r["found"]]}


def missing_measures(panel_columns: list[str]) -> list[str]:
    """Variance measures that the archive lacks."""
    return [m for m in VARIANCES if f"var_{m}" not in panel_columns]


def load_series(spark: SparkSession, path: str, value: str, exog: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(ticker, date, value, exog) of a saved panel: only these columns are read; at most ``most`` tickers, in order."""
    out = spark.read.parquet(path)
    if value not in out.columns:
        raise ValueError(f"{path} has no column {value}")
    out = out.select("ticker", "date", value, *[c for c in exog if c in out.columns]).where(F.col(value).isNotNull())
    if most is not None:
        names = [r[0] for r in out.select("ticker").distinct().orderBy("ticker").limit(most).collect()]
        out = out.where(F.col("ticker").isin(names))
    return out
