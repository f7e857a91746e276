"""Tables in the folder that all executors share, and files beside them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, and the master local, a local folder, which becomes the checkpoint folder."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(sc, "_quillion_folder", None)
        if where is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if where is None:
            where = "file://" + tempfile.mkdtemp(prefix="quillion-")
            sc._quillion_folder = where
            sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage is cut, and it outlives any executor, but not the session."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    fs, at = path_of(df.sparkSession, path)
    fs.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int = 1 << 23) -> DataFrame:
    """``df`` over all cores, if it is so small that its files may not be: under ``least`` bytes a core, by Spark's statistics.

    A small file of one row group is one task, whatever follows; larger tables come
    in tasks enough and are left as they are, since this shuffles the rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < least * cores else df


def dense_ids(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with whole numbers from ``start`` in the given order, without a window over all rows.

    Rows are range-partitioned and sorted, numbered within their partition, and
    moved by the counts of the partitions before (a table with a row for each
    partition, joined by Spark's size check).
    """
    plan = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    held = written(plan.withColumn("_mark", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND((1 << 33) - 1)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = held.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, (F.lit(start) + F.col("_before") + row).cast("long")).drop("_mark", "_part", "_before")


def prefix_sums(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, in the given order: 0 for the first, nulls add nothing.

    As ``dense_ids``: sums within range partitions, moved by the totals of the
    partitions before.
    """
    plan = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(plan.withColumn("_mark", F.monotonically_increasing_id()), "summed").withColumn("_part", F.shiftright("_mark", 33))
    totals = held.groupBy("_part").agg(F.sum(value).alias("_total"))  # a row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = held.withColumn("_inside", inside).join(offsets, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_inside")).drop("_mark", "_part", "_before", "_inside")


def path_of(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = path_of(spark, path)
    return fs.exists(at)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path."""
    fs, at = path_of(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, at = path_of(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = path_of(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it isn't there."""
    fs, at = path_of(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A new small file, whole or not at all; an error if it is there already."""
    fs, at = path_of(spark, path)
    _, draft = path_of(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(f"{path} is there already: another writer was first")
