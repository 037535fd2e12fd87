"""Record tables: tab-separated sources, truth, predictions, caches and run registries."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
MATCHES, CANDIDATES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All strings; what is missing is '', and NA or null are ordinary words."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return df.na.fill("")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, RECORD)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_pairs(read_tsv(spark, path, TRUTH).withColumn("line", F.monotonically_increasing_id()))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """entity_id, candidate_id; of several rows of an entity the last (by ``line``) counts."""
    rows = truth
    if "line" in truth.columns:
        last = Window.partitionBy("source1_entity_id").orderBy(F.desc("line"))
        rows = truth.withColumn("n", F.row_number().over(last)).filter("n = 1")
    each = rows.select(F.col("source1_entity_id").alias("entity_id"), F.explode(F.split("matched_entity_ids", ",")).alias("id"))
    return each.select("entity_id", F.trim("id").alias("candidate_id")).filter("candidate_id <> ''").distinct()


def union_targets(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def lookup(records: DataFrame) -> DataFrame:
    """The fields of a record by id."""
    return records.select("entity_id", "business_name", "business_address", "country")


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1")


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines without the header."""
    return max(0, spark.read.text(path).count() - 1)


def line_of(ids: Column, items: Column) -> Column:
    return F.concat_ws("\t", ids, F.array_join(items, ","))


def write_lists(lists: DataFrame, path: str, header: tuple[str, str], id_column: str, items: str, order: str) -> None:
    """One tab-separated file with a header, lists joined by commas, unquoted, in the input's order.

    The lines are sorted by a range-partitioned sort and written as one file each part, of which
    the first carries the header; ``read_lists`` and plain concatenation give the table back."""
    spark = lists.sparkSession
    lines = lists.select(F.col(order).cast("long").alias("order"), line_of(F.col(id_column), F.col(items)).alias("value"))
    head = spark.createDataFrame([(-1, "\t".join(header))], "order long, value string")
    head.unionByName(lines).orderBy("order").select("value").write.mode("overwrite").text(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """id and items (array) of a file that write_lists wrote."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    rows = rows.filter(~F.col("f")[0].isin("source1_entity_id"))
    items = F.filter(F.split(F.coalesce(F.get("f", F.lit(1)), F.lit("")), ","), lambda x: x != "")
    return rows.select(F.col("f")[0].alias("id"), items.alias("items"))


def settings_hash(settings: dict) -> str:
    """Twenty hex digits that name a cache for these settings."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:20]


def source_identity(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, size and modification time of the files, asked of their file system."""
    jvm, out = spark.sparkContext._jvm, []
    for path in sorted(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


def cached(spark: SparkSession, root: str, settings: dict, build) -> DataFrame:
    """A table that is built once per settings: written beside its place and renamed, so that a
    half-written one is never read; one that can't be read is built anew."""
    path = f"{root.rstrip('/')}/{settings_hash(settings)}"
    try:
        return spark.read.parquet(path)
    except Exception as error:  # absent, or not a table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    built = build()
    parts = f"{path}.part"
    built.write.mode("overwrite").parquet(parts)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        return built
    return spark.read.parquet(path)


VERSION = 1


def save_artifact(path: str, settings: dict, values: dict) -> None:
    """Settings and fitted values as JSON, replaced in one step."""
    target = Path(path)
    part = target.with_suffix(".part")
    part.write_text(json.dumps({"version": VERSION, "settings": settings, "values": values}, sort_keys=True))
    part.replace(target)


def load_artifact(path: str, settings: dict, required: tuple[str, ...] = ()) -> dict:
    found = json.loads(Path(path).read_text())
    if found.get("version") != VERSION:
        raise ValueError(f"the artifact has version {found.get('version')}, not {VERSION}")
    if found.get("settings") != json.loads(json.dumps(settings)):
        raise ValueError("the artifact was made with other settings")
    if missing := [k for k in required if k not in found.get("values", {})]:
        raise ValueError(f"the artifact lacks {', '.join(missing)}")
    return found["values"]


def best_run(runs: DataFrame) -> DataFrame:
    """The run with the highest candidate recall (columns timestamp, candidate_recall, ...)."""
    return runs.orderBy(F.desc("candidate_recall"), "timestamp").limit(1)


def run_registry(spark: SparkSession, pattern: str) -> DataFrame:
    """All run records (JSON files) by time; files that don't parse are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema("timestamp string, name string, candidate_recall double").json(pattern)
    return rows.filter("timestamp is not null").orderBy("timestamp")
