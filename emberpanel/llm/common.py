"""Helpers shared by the corpus operators: tables, checkpoints and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, as_table: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, or ``as_table`` with a Parquet table in the same folder.

    A checkpoint hands on the size estimates of its plan, which double their digits with every join, so long loops write a table now
    and then. The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local session (as
    in tests) gets a temporary one; a cluster has none that all its machines share, so there it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    if not as_table:
        return df.checkpoint(eager=True)
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(counted: DataFrame, key: str, count: str, total: int, share: int = 256) -> list:
    """Keys with more than one in ``share`` of ``total`` rows, so fewer than ``share``; ``counted`` has a row a key."""
    return [r[0] for r in counted.where(F.col(key).isNotNull() & (F.col(count) * share > total)).select(key).collect()]


def hot_join(rows: DataFrame, right: DataFrame, key: str, hot: list, spread: Column, places: int = 256) -> DataFrame:
    """Left join with ``right``, which has a row a key. Rows of ``hot`` keys, and of none, go to ``places`` places by ``spread``, and a hot key's row to each of them."""
    if not hot:
        return rows.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    every, one = F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long")), F.array(F.lit(0).cast("long"))
    met = right.withColumn("_place", F.explode(F.when(is_hot, every).otherwise(one)))
    dealt = rows.withColumn("_place", F.when(is_hot | F.col(key).isNull(), F.pmod(spread, F.lit(places))).otherwise(0).cast("long"))
    return dealt.join(met, [key, "_place"], "left").select(*rows.columns, *[c for c in right.columns if c != key])


#: Rows of an Arrow batch between Spark and Python: texts are long, and both sides hold a batch.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give the executors this package once a session, so Python workers can import it wherever they run, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_emberpanel_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(bundle))
    context._emberpanel_shipped = True


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Let a Python worker keep one operator's cache: those of operators that ran in it before are emptied."""
    for other in [name for name in _HELD if name != owner]:
        _HELD.pop(other)()
    _HELD[owner] = clear


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside ``body`` so that it is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def arrow_map(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so a batch of long texts stays small in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null for a null value."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
