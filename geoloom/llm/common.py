"""What several operators of this package share: tables, the shared folder, cuts of the lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch at most: texts are long, and a batch is held by Spark and by the worker.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """Lower-cases A-Z only, so that no character changes its length."""
    return F.translate(text, UPPER, LOWER)


def bounded(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches bounded to BATCH_ROWS rows; a smaller setting stays."""
    spark = docs.sparkSession
    if not 0 < int(spark.conf.get(BATCH_SETTING, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dir:
        _own_dir[key] = tempfile.mkdtemp(prefix="geoloom-")
    return _own_dir[key]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/geoloom-{label}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Returns freed memory to the system. Workers are used for task after task, and what they hold on to counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again: what follows has a short lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
