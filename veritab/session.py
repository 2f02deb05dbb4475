"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What every job here relies on. Partition counts are left to AQE: a large
#: initial number is coalesced on small inputs and split on skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_PREFIX = "veritab-"
_WRITTEN: list[str] = []
_LOCAL = threading.local()
#: Spark's setting: a query that has ended takes its shuffle files with it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "veritab", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where all of Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="veritab-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage of data that several later steps read: a lost executor
    costs a re-read instead of a re-run, and the planner gets real sizes. What was
    shuffled for it goes with the write, not when the driver happens to collect its garbage.
    """
    return _written(df, getattr(_LOCAL, "tables", _WRITTEN))


def _written(df: DataFrame, tables: list[str]) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{_PREFIX}{uuid.uuid4().hex}"
    tables.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What this thread writes by ``durable`` in the block is deleted at its end. Gives a ``durable`` whose tables stay."""
    outer = getattr(_LOCAL, "tables", _WRITTEN)
    _LOCAL.tables = []
    try:
        yield lambda df: _written(df, outer)
    finally:
        _delete(spark, _LOCAL.tables)
        _LOCAL.tables = outer


def bound_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Let Arrow batches of this session end after about ``size`` bytes, so that long texts don't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > size:
        spark.conf.set(key, str(size))


def drop_durable(spark: SparkSession) -> int:
    """Delete the tables that ``durable`` wrote in this process, once nothing reads them any more; how many."""
    return _delete(spark, _WRITTEN)


def _delete(spark: SparkSession, tables: list[str]) -> int:
    count = len(tables)
    while tables:
        place = spark._jvm.org.apache.hadoop.fs.Path(tables.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return count
