"""Where tables go and come from: Parquet stores, size-budgeted JSON parts, idempotent seeding, the audit log."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.operators.store import upsert
from stemma.util import cut, ship


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    (out.write.mode("overwrite").partitionBy(*partition_by) if partition_by else out.write.mode("overwrite")).parquet(path)


#: Parts that one task fills; a table of fewer is cut exactly as one pass over it would.
_PARTS_PER_TASK = 64


def _filled(batches: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """Greedy fill of one sorted partition: a part ends before the row that would exceed the budget."""
    pid, part, used = TaskContext.get().partitionId(), 0, 0  # type: ignore[union-attr]
    for b in batches:
        local = []
        for size in b["size"]:
            if used and used + size > budget:
                part, used = part + 1, 0
            used += size
            local.append(part)
        b["pid"], b["local"] = pid, local
        yield b[["json", "__o", "pid", "local"]]


def parts_of(df: DataFrame, order: str, budget: int, whole: int) -> DataFrame:
    """df as (json, part, __o): parts of at most ``budget`` bytes filled greedily in order, or one part if all is at most ``whole``.

    A row longer than the budget has a part of its own. Ranges of about 64 parts are filled by a task each, so that a part also ends where a range does.
    """
    ship(df.sparkSession)
    j = df.select(F.to_json(F.struct(*df.columns)).alias("json"), F.col(order).cast("long").alias("__o")).withColumn("size", F.octet_length("json") + 1)
    total = j.agg(F.sum("size")).first()[0] or 0
    if total <= whole:
        return j.select("json", F.lit(1).alias("part"), "__o")
    ranges = max(1, total // (_PARTS_PER_TASK * budget))
    rows = cut(j.repartitionByRange(ranges, "__o").sortWithinPartitions("__o").mapInPandas(lambda it: _filled(it, budget), "json string, __o long, pid int, local int"))
    counts = rows.groupBy("pid").agg((F.max("local") + 1).alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per task
    return rows.join(F.broadcast(starts), "pid").select("json", (F.col("start") + F.col("local") + 1).cast("int").alias("part"), "__o")


def write_parts(df: DataFrame, path: str, order: str, budget: int = 15 << 20, whole: int = 20 << 20) -> None:
    """JSON lines in directories part=1.. of bounded size with a manifest of their number; what was there is replaced."""
    p = parts_of(df, order, budget, whole)
    p.repartition("part").sortWithinPartitions("part", "__o").select("json", "part").write.mode("overwrite").partitionBy("part").text(f"{path}/parts")
    p.agg(F.max("part").alias("parts")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all parts; FileNotFoundError if the manifest counts more than there are."""
    want = spark.read.json(f"{path}/manifest").first()["parts"]
    lines = spark.read.text(f"{path}/parts")
    have = lines.select("part").distinct().count()
    if have != want:
        raise FileNotFoundError(f"{path}: {have} of {want} parts")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def seed(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str] = ("id",), force: bool = False) -> bool:
    """Write rows where nothing is stored yet; with ``force`` put them into what is. Returns whether anything was written."""
    try:
        old = spark.read.parquet(path)
        filled = not old.isEmpty()
    except AnalysisException:
        old, filled = None, False
    if filled and not force:
        return False
    new = upsert(old, rows, list(keys)) if filled else rows
    tmp = f"{path}.{uuid.uuid4().hex}"
    new.write.parquet(tmp)
    spark.read.parquet(tmp).write.mode("overwrite").parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(tmp)
    fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, True)
    return True


def seed_all(steps: Iterable[tuple[str, Callable[[], bool]]]) -> dict[str, str]:
    """Run every step; one that fails doesn't stop the others. Returns 'written', 'kept' or the failure by name."""
    out = {}
    for name, step in steps:
        try:
            out[name] = "written" if step() else "kept"
        except Exception as e:  # noqa: BLE001
            out[name] = f"failed: {e}"
    return out


def record_run(spark: SparkSession, path: str, run: dict, registered: Iterable[str]) -> None:
    """Append one run (source_ids, counts and what else) to the log; ValueError for an unknown source id. Nothing that goes wrong while writing stops an import."""
    if unknown := set(run.get("source_ids", ())) - set(registered):
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    row = {"run_id": uuid.uuid4().hex} | {k: str(v) for k, v in run.items()}
    df = spark.createDataFrame([tuple(row.values())], [*row]).withColumn("timestamp", F.current_timestamp())
    try:
        df.write.mode("append").json(path)
    except Exception as e:  # noqa: BLE001
        print(f"the run isn't logged: {e}")


def run_stages(stages: Sequence[tuple[str, Callable[[dict], DataFrame]]], path: str, spark: SparkSession) -> dict[str, DataFrame]:
    """A fixed chain of stages, each from the tables so far to one more, kept as Parquet so that the next starts from a file."""
    tables: dict[str, DataFrame] = {}
    for name, stage in stages:
        stage(tables).write.mode("overwrite").parquet(f"{path}/{name}")
        tables[name] = spark.read.parquet(f"{path}/{name}")
    return tables
