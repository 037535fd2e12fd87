"""Staged tables, skew-safe joins and session settings that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python; with whole texts inside, a smaller
#: batch than Spark's 10,000 bounds a worker's memory.
ARROW_ROWS = 1000

#: A key is hot when it holds more than one row in HOT_SHARE; so there are
#: fewer than HOT_SHARE hot keys at any size of input, and they fit a broadcast.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="affinis-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/affinis-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: lineage is cut,
    sizes are known to the planner, and a lost executor only repeats a scan."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """64-bit key of a row's text, to tell rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join_hot(rows: DataFrame, side: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows`` inner-joined with ``side`` (one row per key) on ``key``.

    ``hot`` holds the rows of ``side`` for keys with more than 1/HOT_SHARE of all rows,
    fewer than HOT_SHARE of them: these are joined map-side, all others by shuffling."""
    hot_keys = F.broadcast(hot.select(key))
    warm = rows.join(hot_keys, key, "left_anti").join(side.join(hot_keys, key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).unionByName(warm)


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, text_key, kept: one row per input row) keeps.

    Only the ids of dropped rows meet the texts, so the planner may broadcast them when
    their staged size allows. Rows with equal doc_id and equal text of which one is kept
    are thinned apart from the others. Null doc_ids compare as equal."""
    count = (
        decided.groupBy("doc_id", "text_key")
        .agg(F.max("kept").alias("any_kept"), F.sum(F.col("kept").cast("long")).alias("n_kept"), F.count("*").alias("n"))
        .filter("n_kept < n")
    )
    marked = staged(count.select("doc_id", "text_key", "any_kept"), "marked")
    on = ["doc_id", "text_key"]
    keyed = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("text_key"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])

    untouched = keyed.join(marked, same(keyed, marked), "left_anti")
    partly = marked.filter("any_kept")
    # of rows alike in both but not in other columns the first by all columns, so that a repetition keeps the same
    thinned = keyed.join(partly, same(keyed, partly), "left_semi").groupBy(*on).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return untouched.unionByName(thinned).select("row.*")
