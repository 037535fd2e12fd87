"""Tables that later plans start from, written once: lineage and plans stay short, sizes are
known, and a lost executor only repeats a scan."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Spark's setting of whether a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: dict[tuple, str] = {}
#: For each table that is being built by ``once``: the folders staged for it.
_INNER: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="affinis-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    return staged_parts(df.sparkSession, [df])


def staged_parts(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """The union of one or more frames, each written, and its shuffle files freed, before the next is planned."""
    path = f"{shared_dir(spark)}/affinis-{uuid.uuid4().hex}"
    if _INNER:
        _INNER[-1].append(path)
    return spark.read.schema(_write(spark, parts, path)).parquet(path)


def _write(spark: SparkSession, parts: Iterable[DataFrame], path: str) -> StructType:
    schema = None
    for part in parts:
        if schema is not None:
            _free(spark)
        schema = part.schema
        with _cleaned(spark):
            part.write.mode("append").parquet(path)
        del part
    return schema


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """A query that is run here deletes its shuffle files as it ends, and not when the driver's garbage collector comes to it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _free(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle when the driver collects the plans that refer to it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """The staged table of this key, built on its first use in an application. ``build`` gives a frame or the parts
    of one; what it staged on the way is deleted when the table is written."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _MADE:
        path, outer = f"{shared_dir(spark)}/affinis-{uuid.uuid4().hex}", _INNER[:]
        _INNER[:] = [[]]
        try:
            made = build()
            _write(spark, [made] if isinstance(made, DataFrame) else made, path)
            del made
            inner = _INNER[0]
        finally:
            _INNER[:] = outer
        for folder in inner:
            _delete(spark, folder)
        _free(spark)
        _MADE[full] = path
    return spark.read.parquet(_MADE[full])


def has(spark: SparkSession, key: tuple) -> bool:
    return (spark.sparkContext.applicationId, *key) in _MADE


def drop(table: DataFrame) -> None:
    """Deletes a table made by ``staged``, which nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget() -> None:
    """The next use of each key builds its table anew."""
    _MADE.clear()
