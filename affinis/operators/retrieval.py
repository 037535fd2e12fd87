"""Retrieval: ranked candidates of all queries.

Query keys meet postings, scores add up per query, channel and candidate; queries with
few candidates get those of the phonetic channel, and of character TF-IDF if there are still
few. Each channel passes its best candidates on, ranked with the context score of the pair,
and the union is ranked by the sum.

``retrieve`` does this by blocks of queries (see ``search``), which makes no row of a pair that
isn't ranked. ``retrieve_pairs`` is the same as a plan over pairs, step by step; it is used where all
pairs are asked for, and for the few queries that character TF-IDF steps in for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions import similarity as S
from affinis.functions.constants import CHANNELS, FALLBACK_BELOW
from affinis.operators import blocking as B
from affinis.operators import search as SR
from affinis.sources.staging import staged

DIGITS = 9
CONTEXT_FIELDS = ["country", "name_words", "address_words", "city_words", "postals", "house_base"]


def channel_scores(query_keys: DataFrame, postings: DataFrame, documents: Column, how: B.Blocking) -> DataFrame:
    """query_id, channel, candidate_id, score: weight times idf, added over shared keys of both scopes.

    ``documents`` is the count of target records."""
    weights = F.broadcast(B.channels(postings.sparkSession, how).select("channel", "weight"))
    hits = query_keys.withColumnRenamed("entity_id", "query_id").join(postings, B.KEY).join(weights, "channel")
    part = F.col("weight") * S.idf(F.col("df"), documents)
    return hits.groupBy("query_id", "channel", "candidate_id").agg(F.round(F.sum(F.round(part, DIGITS + 3)), DIGITS).alias("score"))


def sparse_queries(queries: DataFrame, scores: DataFrame, below: int = FALLBACK_BELOW) -> DataFrame:
    """query_ids (column entity_id of ``queries``) with fewer than ``below`` candidates so far, none included."""
    enough = scores.groupBy("query_id").agg(F.count_distinct("candidate_id").alias("n")).filter(F.col("n") >= below)
    return queries.select(F.col("entity_id").alias("query_id")).distinct().join(enough, "query_id", "left_anti")


def context(query: str, target: str) -> Column:
    """Score of a pair of profiles under the struct columns ``query`` and ``target``."""
    q, t = F.col(query), F.col(target)
    same_house = (q["house_base"] != "") & (q["house_base"] == t["house_base"])
    conflict = (q["country"] != "") & (t["country"] != "") & (q["country"] != t["country"])
    return (
        9.0 * S.overlap(q["postals"], t["postals"]).cast("double")
        + 4.0 * same_house.cast("double")
        + 3.0 * S.jaccard(q["address_words"], t["address_words"])
        + 2.0 * S.jaccard(q["city_words"], t["city_words"])
        + 1.0 * S.jaccard(q["name_words"], t["name_words"])
        - 4.0 * conflict.cast("double")
    )


def fields(profiles: DataFrame, id_name: str, name: str) -> DataFrame:
    return profiles.select(F.col("entity_id").alias(id_name), F.struct(*CONTEXT_FIELDS).alias(name))


def with_context(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, candidate_id and context of each distinct pair."""
    joined = pairs.select("query_id", "candidate_id").distinct().join(fields(queries, "query_id", "q"), "query_id").join(fields(targets, "candidate_id", "t"), "candidate_id")
    return joined.select("query_id", "candidate_id", F.round(context("q", "t"), DIGITS).alias("context"))


def channel_top(scores: DataFrame, contexts: DataFrame, how: B.Blocking) -> DataFrame:
    """The best candidates of each query and channel by score and context, ties by id."""
    limits = F.broadcast(B.channels(scores.sparkSession, how).select("channel", "top"))
    order = Window.partitionBy("query_id", "channel").orderBy(F.desc(F.round(F.col("score") + F.col("context"), DIGITS)), "candidate_id")
    most = max(1, int(-(-(max(limit for _, limit, _ in CHANNELS.values()) * how.limit_multiplier) // 1)))
    ranked = scores.join(contexts, ["query_id", "candidate_id"]).withColumn("place", F.row_number().over(order))
    ranked = ranked.filter(F.col("place") <= most)  # a constant, so that the limit is applied before the shuffle too
    return ranked.join(limits, "channel").filter("place <= top").drop("top")


def rank(selected: DataFrame, how: B.Blocking) -> DataFrame:
    """query_id, candidate_id, score, context, channels (sorted array), rank."""
    total = F.sum("score")
    merged = selected.groupBy("query_id", "candidate_id").agg(
        total.alias("total"), F.first("context").alias("context"), F.sort_array(F.collect_list("channel")).alias("channels")
    )
    n = F.size("channels")
    if how.context == "per_channel":
        score = F.col("total") + n * F.col("context")
    else:
        score = F.col("total") + F.col("context") + 0.5 * F.log1p((n - 1).cast("double"))
    scored = merged.select("query_id", "candidate_id", F.round(score, DIGITS).alias("score"), "context", "channels")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return scored.withColumn("rank", F.row_number().over(order))


def retrieve(queries: DataFrame, targets: DataFrame, how: B.Blocking = B.DEFAULT, max_candidates: int = 25, semantic=None) -> DataFrame:
    """Ranked candidates (profiles in, one row per pair out). ``semantic``, if given, maps the
    frame of sparse query_ids to scores of the channel name_tfidf."""
    ranked = SR.by_blocks(queries, targets, how, max_candidates)
    if semantic is None:
        return ranked.drop("found")
    ranked = staged(ranked)
    enough = ranked.filter(F.col("found") >= FALLBACK_BELOW)
    few = queries.join(enough.select(F.col("query_id").alias("entity_id")).distinct(), "entity_id", "left_anti")
    return enough.drop("found").unionByName(retrieve_pairs(few, targets, how, max_candidates, semantic))


def retrieve_pairs(queries: DataFrame, targets: DataFrame, how: B.Blocking = B.DEFAULT, max_candidates: int = 25, semantic=None) -> DataFrame:
    """The same with a row for every pair that shares a key."""
    target_keys = B.keys(targets, how)
    posted = B.postings(target_keys, B.key_frequencies(target_keys), how)
    documents = targets.agg(F.count("*").alias("documents"))
    query_keys = B.keys(queries, how)
    posted = posted.join(F.broadcast(documents))  # one row
    n = F.col("documents")
    plain = query_keys.filter(~F.col("channel").isin(*B.FALLBACK_CHANNELS))
    scores = channel_scores(plain, posted, n, how)
    sparse = sparse_queries(queries, scores)
    phonetic = query_keys.filter(F.col("channel").isin(*B.FALLBACK_CHANNELS)).join(sparse.withColumnRenamed("query_id", "entity_id"), "entity_id", "left_semi")
    scores = scores.unionByName(channel_scores(phonetic, posted, n, how))
    if semantic is not None:
        scores = scores.unionByName(semantic(sparse_queries(queries, scores)))
    selected = channel_top(scores, with_context(scores, queries, targets), how)
    ranked = rank(selected, how)
    return ranked.filter(F.col("rank") <= max_candidates) if max_candidates > 0 else ranked


def candidate_lists(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per query, with its candidates in rank order; empty where there are none."""
    lists = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))), lambda c: c["candidate_id"]).alias("candidates"))
    every = queries.select(F.col("entity_id").alias("query_id"))
    return every.join(lists, "query_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
