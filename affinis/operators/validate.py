"""Checks of written predictions, as rows of (rule, severity, count, examples)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


def _finding(rows: DataFrame, rule: str, severity: str, example: Column) -> DataFrame:
    """Count and first examples; the examples come from a sorted head, not from a list of all."""
    found = rows.select(example.cast("string").alias("example"))
    head = found.distinct().orderBy("example").limit(EXAMPLES).agg(F.array_join(F.sort_array(F.collect_list("example")), ",").alias("examples"))
    return found.agg(F.count("*").alias("n")).join(F.broadcast(head)).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def check_header(line: str | None, header: tuple[str, str]) -> list[str]:
    """What is wrong with a file's first line."""
    if not line:
        return ["the file is empty"]
    if line == "\t".join(header):
        return []
    return ["the header is separated by commas, not tabs"] if line == ",".join(header) else [f"the header is {line!r}"]


def malformed(lines: DataFrame) -> DataFrame:
    """Lines (column value) without a tab."""
    return _finding(lines.filter("value <> '' and not contains(value, '\t')"), "malformed_row", "error", F.col("value"))


def check_lists(lists: DataFrame, queries: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Rules on a table (id, items) of matches or candidates; unknown targets if ``targets`` is given."""
    each = lists.select("id", F.explode("items").alias("item"))
    repeated = lists.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    twice = lists.filter(F.size("items") != F.size(F.array_distinct("items")))
    own = queries.select(F.col("entity_id").alias("id")).distinct()
    rules = [
        _finding(repeated, "duplicate_row", "error", F.col("id")), _finding(twice, "duplicate_in_list", "error", F.col("id")),
        _finding(each.filter("item like 'S1-%'"), "self_match", "error", F.col("item")),
        _finding(each.filter(~F.col("item").rlike("^S[123]-")), "wrong_prefix", "error", F.col("item")),
        _finding(own.join(lists, "id", "left_anti"), "missing_row", "error", F.col("id")), _finding(lists.join(own, "id", "left_anti"), "extra_row", "error", F.col("id")),
    ]
    if targets is not None:
        unknown = each.join(targets.select(F.col("entity_id").alias("item")).distinct(), "item", "left_anti")
        rules.append(_finding(unknown, "unknown_target", "error", F.col("item")))
    return reduce(DataFrame.unionByName, rules)


def check_subset(matches: DataFrame, candidates: DataFrame, severity: str = "warning") -> DataFrame:
    """Matches that are not among the candidates; an error for a pipeline's own output."""
    both = matches.join(candidates.withColumnRenamed("items", "among"), "id", "left")
    outside = both.filter(F.size(F.array_except("items", F.coalesce("among", F.array().cast("array<string>")))) > 0)
    return _finding(outside, "match_not_candidate", severity, F.col("id"))


def check_order(ids: DataFrame, matches: DataFrame, candidates: DataFrame, cap: int) -> DataFrame:
    """The stricter check of a pipeline's own output: three tables (place, id, and items) in the
    same order, candidates within the cap, matches among them."""
    named = ids.select("place", F.col("id").alias("i")), matches.select("place", F.col("id").alias("m")), candidates.select("place", F.col("id").alias("c"))
    zipped = named[0].join(named[1], "place", "full").join(named[2], "place", "full")
    off = zipped.filter(~(F.col("i").eqNullSafe(F.col("m")) & F.col("i").eqNullSafe(F.col("c"))))
    over = candidates.filter(F.size("items") > cap) if cap > 0 else candidates.limit(0)
    subset = check_subset(matches.select("id", "items"), candidates.select("id", "items"), "error")
    return _finding(off, "order_differs", "error", F.col("place")).unionByName(_finding(over, "over_cap", "error", F.col("id"))).unionByName(subset)


def validate(matches: DataFrame, candidates: DataFrame, queries: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """All rules on both tables, with the table's name."""
    parts = [
        check_lists(matches, queries, targets).withColumn("file", F.lit("matches")), check_lists(candidates, queries, targets).withColumn("file", F.lit("candidates")),
        check_subset(matches, candidates).withColumn("file", F.lit("both")),
    ]
    return reduce(DataFrame.unionByName, parts)
