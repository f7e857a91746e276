"""Session plumbing that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per SparkContext, by way of the shared folder.

    Arrow batches are made smaller too, where the session leaves their size at the
    default: 10,000 texts at once fill hundreds of MB on both sides.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    if getattr(sc, "_quillion_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(_PACKAGE.parent).as_posix())
    where = f"{shared_dir(spark)}/quillion-{uuid.uuid4().hex}.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(where)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    sc.addPyFile(where)
    sc._quillion_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Where that is unset a local
    folder is made and set, but only under a local master: on a cluster each
    executor would write to its own disk, so there it is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(sc, "_quillion_dir", None)
        if where is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if where is None:
            where = "file://" + tempfile.mkdtemp(prefix="quillion-shared-")
            sc._quillion_dir = where
            sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what was computed outlives any executor.  The table is
    deleted when the session's JVM ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillion_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    path = getattr(df, "_quillion_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return what this Python worker has freed to the machine: workers live on for other stages.

    From the first call on Arrow allocates from the C library as well, which gives back more than its own pool.
    """
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores added until no column of ``df`` has it, in whatever case: Spark tells no case apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_numbers(df: DataFrame, column: str) -> None:
    """An error unless the ids in ``column`` are whole numbers."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column} must be a whole number, not {kind.simpleString()}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
