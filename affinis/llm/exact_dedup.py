"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D].
Every row is reduced to its digest first. Misra-Gries frequent-item summaries
(Spark's mergeable ``approx_top_k`` sketch, a Misra-Gries variant with block-wise
decrements) are built per group of partitions and merged; the digests they report are
counted exactly, and the winners of those that hold more than 1/HOT_SHARE of the rows are
broadcast and applied map-side. All other digests go through an ordinary shuffle, in
which no group can hold more rows than that share.

The sketch decides only which way a digest takes, never its result: a hot digest that
it missed would be shuffled and still be right.

Defined cases: a null text counts as empty, so null, empty and white-space-only texts are
one group. Of rows that tie in length and doc_id exactly one is kept; a null doc_id counts
as larger than any other. Texts of any length are hashed whole. Further columns of the input are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm._shared import HOT_SHARE, keep_rows, staged, text_key

WHITE = r"[\x20\x09-\x0D]+"
#: Counters of one sketch: four times the hot digests there can be.
TRACKED = 4 * HOT_SHARE
#: Sketches that partitions are first merged into, before these meet in one task.
MERGERS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest (hex SHA-256 of the normalised text), length in code points,
    and a row_id that is unique once the frame is staged."""
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        text_key(docs["text"]).alias("text_key"),
        F.sha2(normalised(docs["text"]).cast("binary"), 256).alias("digest"),
        F.length(F.coalesce(docs["text"], F.lit(""))).alias("chars"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def frequent_digests(rows: DataFrame, tracked: int = TRACKED, mergers: int = MERGERS) -> DataFrame:
    """Digests that Misra-Gries summaries report as frequent: at most ``tracked`` rows."""
    parts = rows.groupBy((F.spark_partition_id() % mergers).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch")
    )
    # grouped by a constant: a partition without sketches then takes no part, which the sketch functions can't bear
    top = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {tracked // 4})").alias("top"))
    return top.select(F.explode("top").alias("item")).select(F.col("item.item").alias("digest"))


def _rank() -> Column:
    """Smallest for the row of a group that stays; no two rows have the same."""
    return F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_id"))


def groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, text_key, digest, keep_id, group_size, kept."""
    rows = staged(digests(docs), "digests").withColumn("rank", _rank())
    n = rows.count()
    candidates = F.broadcast(frequent_digests(rows))  # at most TRACKED / 4 rows
    counted = rows.join(candidates, "digest").groupBy("digest").agg(F.min("rank").alias("best"), F.count("*").alias("group_size"))
    # the filter holds for fewer than HOT_SHARE digests, whatever n is
    hot = staged(counted.filter(F.col("group_size") * HOT_SHARE > n), "hot_digests")
    heavy = rows.join(F.broadcast(hot), "digest")
    light = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    # a grouped minimum is summed map-side, and its staged rows say how large a join is
    winners = staged(light.groupBy("digest").agg(F.min("rank").alias("best"), F.count("*").alias("group_size")), "winners")
    light = light.join(winners, "digest")
    return heavy.unionByName(light).select(
        "doc_id", "text_key", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept")
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    decided = staged(groups(docs).select("doc_id", "text_key", "kept"), "decided")
    return keep_rows(docs, decided)
