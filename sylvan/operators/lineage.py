"""Cutting lineage: a table in the shared folder in place of a plan that several later steps would repeat."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests) may go without the setting; it then gets a folder of its own, which ends with it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="sylvan-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/sylvan-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _end() -> None:
    for path, spark in _FOLDERS.items():
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sylvan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of :func:`cut`, once nothing will read it again."""
    remove(df.sparkSession, df._sylvan_path)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Have this session send rows to Python in batches of at most ``most`` bytes: long texts make rows a poor measure, and
    both the executor's buffers and the worker hold a batch whole. A smaller setting of the session's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= most:
        spark.conf.set(key, str(most))
