"""Shared plan helpers: durable cut points, size-checked broadcasts, first-wins dedupe, islands."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast. Beyond it the same join is left to the shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only a local session, which is one machine, gets a temporary one where the setting is unset; any other raises."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="stemma-ckpt-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_CUTS: dict[str, list[str]] = {}


def clean(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut` wrote in this application, once nothing reads results that stem from them. Returns how many."""
    n = 0
    paths = _CUTS.get(spark.sparkContext.applicationId, [])
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def _clean_at_exit() -> None:
    """What an application leaves when it ends, so that the shared folder doesn't grow from run to run."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            clean(spark)


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back.

    Cuts the lineage in one job, survives the loss of executors, and gives the
    planner true sizes. An empty frame keeps its schema. The table is deleted by :func:`clean`, or when the driver ends.
    ``tidy`` is for jobs that many of these follow each other in: stronger compression, and the shuffle files are deleted once the table is written.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    if not tidy:
        df.write.parquet(path)
    else:
        before = spark.conf.get(_TIDY, None)
        spark.conf.set(_TIDY, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the tables that :func:`cut` wrote and these frames read; nothing else may read them any more."""
    for df in tables:
        spark = df.sparkSession
        mine = _CUTS.get(spark.sparkContext.applicationId, [])
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for path in [p for p in mine if p.rsplit("/", 1)[1] in names]:
            mine.remove(path)
            gone = spark._jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the checkpoint folder for files of any kind; deleted as cut tables are."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _CUTS:
        atexit.register(_clean_at_exit)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut_counting(df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """As :func:`cut`, with the number of rows that meet each condition, counted while they are written."""
    seen = Observation()
    counts = [F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()]
    written = cut(df.observe(seen, *counts))
    return written, {k: seen.get[k] for k in conditions}


#: Bytes up to which a side may be broadcast by :func:`broadcast_if_small`.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast only if it has at most ``rows`` rows and the planner puts it at no more than ``size`` bytes; otherwise leave the strategy to the planner.

    df should be cheap to count and its size known, as after :func:`cut` (the files' size).
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > size:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has at most half as many partitions as there are cores (one small file); otherwise as it is.

    Large inputs never meet the condition, and so never pay for the exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the given order. Null keys form a group of their own.

    The planner limits each group on the map side too (a partial WindowGroupLimit), so that
    of a hot key every task sends one row; the sort spills where it must.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the place of each row in its group, from 1, by ``order``. A hot group is spread over ranges: rows are numbered within ranges, and a range begins where those before it end."""
    at = "__range"
    ranged = cut(df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, *keys, *order).withColumn(at, F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, at).agg(F.count("*").alias("__n"))  # a row per group and range
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(at).alias("__at"), before.alias("__before"))
    same = F.col(at) == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = F.row_number().over(Window.partitionBy(*keys, at).orderBy(*order))
    numbered = ranged.withColumn("__local", local).join(starts, same)
    return numbered.select(*df.columns, (F.col("__local") + F.col("__before")).cast("int").alias(name))


def islands(df: DataFrame, partition: Sequence[str], value: str, name: str = "island") -> DataFrame:
    """Number runs of consecutive integers: rows of one run share value - row_number."""
    w = Window.partitionBy(*partition).orderBy(value)
    return df.withColumn(name, F.col(value) - F.row_number().over(w))


def try_int(col: Column) -> Column:
    """Leading integer of a text, as a lenient parser reads it; null if there is none."""
    return F.regexp_extract(F.coalesce(col, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the Python workers."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="stemma-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/stemma.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
