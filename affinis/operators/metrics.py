"""Quality figures of candidates, scores and predictions, each as one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.constants import CHANNELS, RECALL_RANKS

PERCENTILES = (0.5, 0.95, 0.99)


def entity_f05(tp: Column, predicted: Column, actual: Column) -> Column:
    """F0.5 of an entity; 1 where nothing is predicted and nothing is there."""
    fp, fn = predicted - tp, actual - tp
    bottom = 1.25 * tp + fp + 0.25 * fn
    return F.when(bottom == 0, F.lit(1.0)).otherwise(1.25 * tp / bottom)


def entity_counts(entities: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """entity_id, tp, predicted, actual for every entity (pairs are entity_id, candidate_id)."""
    pair = ["entity_id", "candidate_id"]
    marked = predicted.select(*pair).distinct().withColumn("p", F.lit(1)).join(truth.select(*pair).distinct().withColumn("t", F.lit(1)), pair, "full")
    sums = marked.groupBy("entity_id").agg(F.sum(F.when(F.col("p") + F.col("t") == 2, 1).otherwise(0)).alias("tp"), F.count("p").alias("predicted"), F.count("t").alias("actual"))
    return entities.select("entity_id").distinct().join(sums, "entity_id", "left").na.fill(0, ["tp", "predicted", "actual"])


def macro_f05(entities: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    found = entity_counts(entities, predicted, truth)
    return found.agg(F.avg(entity_f05(F.col("tp"), F.col("predicted"), F.col("actual"))).alias("macro_f05"), F.count("*").alias("entities"))


def universe(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """The entities that occur in either."""
    return predicted.select("entity_id").union(truth.select("entity_id")).distinct()


def recall_at(ranked: DataFrame, truth: DataFrame, queries: DataFrame, ranks=RECALL_RANKS) -> DataFrame:
    """k, hits, recall and kept (mean candidates up to k), for all k in one pass over the pairs."""
    labelled = ranked.select("query_id", "candidate_id", "rank").join(truth.select(F.col("entity_id").alias("query_id"), "candidate_id", F.lit(1).alias("hit")), ["query_id", "candidate_id"], "left")
    sums = [F.sum(F.when((F.col("rank") <= k) & F.col("hit").isNotNull(), 1).otherwise(0)).alias(f"hits_{k}") for k in ranks]
    kept = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"kept_{k}") for k in ranks]
    one = labelled.agg(*sums, *kept)
    totals = truth.join(queries.select("entity_id").distinct(), "entity_id", "left_semi").agg(F.count("*").alias("truths"))
    n = queries.agg(F.count_distinct("entity_id").alias("queries"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"hits_{k}", F.lit(0)).alias("hits"), F.coalesce(f"kept_{k}", F.lit(0)).alias("kept")) for k in ranks])).alias("r")
    wide = one.join(F.broadcast(totals)).join(F.broadcast(n)).select(rows, "truths", "queries")  # one row each
    recall = F.when(F.col("truths") == 0, F.lit(1.0)).otherwise(F.col("r.hits") / F.col("truths"))
    return wide.select("r.k", "r.hits", F.round(recall, 6).alias("recall"), F.round(F.col("r.kept") / F.col("queries"), 6).alias("kept"))


def size_summary(sizes: DataFrame, column: str) -> DataFrame:
    """Mean, nearest-rank percentiles and maximum of a column of counts."""
    at = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("long").alias(f"p{int(p * 100)}") for p in PERCENTILES]
    return sizes.agg(F.round(F.avg(column), 6).alias("mean"), *at, F.max(column).cast("long").alias("max"))


def candidate_sizes(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select(F.col("entity_id").alias("query_id")).join(counts, "query_id", "left").na.fill(0, ["n"])


def channel_recall(queries: DataFrame, selected: DataFrame, truth: DataFrame) -> DataFrame:
    """channel, candidates, hits and mean size, for every channel, empty ones included."""
    spark = queries.sparkSession
    names = spark.createDataFrame([(c,) for c in CHANNELS], "channel string")
    # a pair meets the truth once, with its channels as bits, and only sums are dealt out to channels
    bits = reduce(Column.__add__, [F.array_contains("channels", c).cast("int") * F.lit(1 << i) for i, c in enumerate(CHANNELS)])
    known = truth.select(F.col("entity_id").alias("query_id"), "candidate_id", F.lit(1).alias("hit"))
    pairs = selected.select("query_id", "candidate_id", bits.alias("bits")).join(known, ["query_id", "candidate_id"], "left")
    of_bits = pairs.groupBy("bits").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    channels = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(CHANNELS)]), lambda c: c.isNotNull())
    sums = of_bits.select(F.explode(channels).alias("channel"), "n", "hits").groupBy("channel").agg(F.sum("n").alias("candidates"), F.sum("hits").alias("hits"))
    n = queries.agg(F.count_distinct("entity_id").alias("queries"))
    out = names.join(sums, "channel", "left").na.fill(0, ["candidates", "hits"]).join(F.broadcast(n))
    return out.select("channel", "candidates", "hits", F.round(F.col("candidates") / F.col("queries"), 6).alias("mean_size"))


def score_distribution(scores: DataFrame, column: str, *by: str) -> DataFrame:
    """Count, mean, population deviation and interpolated percentiles."""
    at = [F.round(F.percentile(column, p), 6).alias(f"p{int(p * 100):02d}") for p in (0.01, 0.05, 0.5, 0.95, 0.99)]
    return scores.groupBy(*by).agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_pop(column), 6).alias("deviation"), *at)


def pair_metrics(scored: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall, Brier score and log loss (clipped) of scored pairs and predictions, and
    precision and recall for either source. scored: entity_id, candidate_id, label, probability."""
    pair = ["entity_id", "candidate_id"]
    both = predicted.select(*pair).distinct().withColumn("p", F.lit(1)).join(truth.select(*pair).distinct().withColumn("t", F.lit(1)), pair, "full")
    hit = (F.col("p") == 1) & (F.col("t") == 1)

    def rates(name: str, only: Column) -> list[Column]:
        tp, p, t = (F.sum(F.when(only & c, 1).otherwise(0)) for c in (F.coalesce(hit, F.lit(False)), F.col("p").isNotNull(), F.col("t").isNotNull()))
        return [F.round(F.when(p > 0, tp / p).otherwise(1.0), 6).alias(f"{name}precision"), F.round(F.when(t > 0, tp / t).otherwise(1.0), 6).alias(f"{name}recall")]

    sides = [c for name, source in (("", ""), ("s2_", "S2-"), ("s3_", "S3-")) for c in rates(name, F.col("candidate_id").startswith(source))]
    clipped = F.least(F.greatest(F.col("probability"), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -F.when(F.col("label") == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    errors = scored.agg(F.round(F.avg((F.col("probability") - F.col("label")) ** 2), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"))
    return both.agg(*sides).join(F.broadcast(errors))  # one row each


def linked_metrics(counts: DataFrame) -> DataFrame:
    """Of entity_counts: precision and recall of being linked at all, and F0.5 by kind of entity."""
    predicted, actual = F.col("predicted") > 0, F.col("actual") > 0
    f = entity_f05(F.col("tp"), F.col("predicted"), F.col("actual"))

    def share(c: Column, of: Column) -> Column:
        n = F.sum(of.cast("int"))
        return F.round(F.when(n > 0, F.sum((c & of).cast("int")) / n).otherwise(1.0), 6)

    return counts.agg(
        share(actual, predicted).alias("linked_precision"), share(predicted, actual).alias("linked_recall"), F.round(F.avg(F.when(~actual, f)), 6).alias("singleton_f05"),
        F.round(F.avg(F.when(actual, f)), 6).alias("linked_f05"), F.round(F.avg(F.when(F.col("actual") > 1, f)), 6).alias("multi_f05"),
    )


def fold_summary(values: DataFrame, column: str) -> DataFrame:
    return values.agg(*[F.round(f(column), 6).alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))])
