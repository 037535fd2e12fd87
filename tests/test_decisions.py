"""Thresholds against brute force, sampling contracts, validation."""

import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis import catalogue
from affinis.functions.constants import MARGINS, PAIR_FEATURES
from affinis.operators import metrics as M
from affinis.operators import sampling as N
from affinis.operators import thresholds as TH
from affinis.operators import validate as V
from affinis.plans import models as ML
from affinis.sources.staging import staged

SCORED = "entity_id string, candidate_id string, label int, probability double"


def f05(tp, n, t):
    bottom = 1.25 * tp + (n - tp) + 0.25 * (t - tp)
    return 1.0 if bottom == 0 else 1.25 * tp / bottom


def brute(rows, actual, boundary, margin):
    total = 0.0
    for e, t in actual.items():
        mine = [r for r in rows if r[0] == e]
        top = max((r[3] for r in mine), default=0.0)
        kept = [r for r in mine if (boundary is None or r[3] > boundary) and (margin is None or r[3] >= round(max(0.0, top - margin), 9))]
        total += f05(sum(r[2] for r in kept), len(kept), t)
    return total / len(actual)


@pytest.mark.parametrize("seed", range(3))
def test_sweep_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"e{e}", f"c{c}", rng.randrange(2), rng.randrange(11) / 10) for e in range(6) for c in range(rng.randrange(5))]
    actual = {f"e{e}": sum(r[2] for r in rows if r[0] == f"e{e}") + rng.randrange(2) for e in range(7)}
    points = TH.sweep(spark.createDataFrame(rows, SCORED), spark.createDataFrame(list(actual.items()), "entity_id string, actual int"))
    found = {(r.margin, r.boundary): r.score for r in points.collect()}
    assert {m for m, _ in found} == set(MARGINS)
    for (margin, boundary), score in found.items():
        assert score == pytest.approx(brute(rows, actual, boundary, margin), abs=1e-8)
    boundary, margin, score = TH.choose(points)
    assert score == pytest.approx(max(found.values()), rel=2e-5)
    kept = TH.predictions(spark.createDataFrame(rows, SCORED), boundary, margin)
    truthless = brute(rows, actual, boundary, margin)
    assert truthless == pytest.approx(score, abs=1e-8) and kept.count() <= len(rows)


def test_the_best_point_is_found_without_all_points_in_the_driver(spark):
    """300,000 points of six margins would take over 60 MB, and come in pieces; in what order partitions have them doesn't matter."""
    margin = F.element_at(F.array(*[F.lit(m).cast("double") for m in MARGINS]), (F.col("id") % 6 + 1).cast("int"))
    boundary = F.when(F.col("id") >= 6, F.floor(F.col("id") / 6) / 50_000)
    score = F.round(0.9 - F.abs(F.floor(F.col("id") / 6) - 11_000) / 1e6 - (F.col("id") % 6 - 2) ** 2 / 1e3, 9)
    points = staged(spark.range(300_000).select(margin.alias("margin"), boundary.alias("boundary"), score.alias("score")).repartition(8))
    tracemalloc.start()
    try:
        found, step = TH.choose(points), TH.choose_step(points.filter("margin = 0.2"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
    best = (-1, -math.inf, -1.0)
    for r in sorted(points.collect(), key=lambda r: (MARGINS.index(r.margin), -math.inf if r.boundary is None else r.boundary)):
        m, at, close = MARGINS.index(r.margin), -math.inf if r.boundary is None else r.boundary, abs(r.score - best[2]) <= 1e-8 + 1e-5 * abs(best[2])
        if (r.score > best[2] and not close) or (close and at > best[1]):
            best = (m, at, r.score)
    assert found == (best[1], MARGINS[best[0]], best[2]) and step[0] is not None


def test_f05_of_nothing_is_one(spark):
    e = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    none = spark.createDataFrame([], "entity_id string, candidate_id string")
    truth = spark.createDataFrame([("b", "x")], "entity_id string, candidate_id string")
    assert M.macro_f05(e, none, truth).first().macro_f05 == 0.5


def test_cardinality_policy(spark):
    p = spark.createDataFrame([("a", 0.7, 0.2, 0.1), ("b", 0.4, 0.35, 0.25), ("c", 0.1, 0.3, 0.6), ("d", 0.5, 0.0, 0.5)], "entity_id string, p0 double, p1 double, p2 double")
    got = {r.entity_id: r.cardinality for r in TH.cardinality_labels(p, {0: 0.6, 1: 0.3, 2: 0.5}).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}


def test_pool_counts(spark):
    rows = N.pool_table(spark, 200).collect()
    assert all(r.hard + r.medium + r.structural + r.random == r.total for r in rows)
    assert all(min(r.hard, r.medium, r.structural, r.random) >= 1 for r in rows if r.total >= 4)


def test_negatives_are_distinct_bounded_and_repeatable(spark):
    rows = spark.range(60).select((F.col("id") % 2).cast("string").alias("entity_id"), F.col("id").cast("string").alias("candidate_id"), (F.col("id") / 7.0).alias("hardness"), F.when(F.col("id") % 3 == 0, "same_city").otherwise("other").alias("category"))
    draws = [sorted((r.entity_id, r.candidate_id) for r in N.mixed_negatives(rows.repartition(n), F.lit(10), 7).collect()) for n in (1, 5)]
    assert draws[0] == draws[1] and len(draws[0]) == len(set(draws[0])) == 20
    assert ("1", "59") in draws[0]  # the hardest


def test_folds_are_stratified(spark):
    e = spark.range(20).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("entity_id"))
    truth = e.limit(10).withColumn("candidate_id", F.lit("x"))
    sizes = N.folds(e, truth, 5).groupBy("linked", "fold").count().collect()
    assert len(sizes) == 10 and all(r["count"] == 2 for r in sizes)


def test_validation_rules(spark):
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S2-1"]), ("S1-1", ["S1-2"]), ("S1-9", ["Q-1"])], "id string, items array<string>")
    queries, targets = (spark.createDataFrame([(x,) for x in ids], "entity_id string") for ids in (["S1-1", "S1-2"], ["S2-1"]))
    got = {r.rule: (r.n, r.examples) for r in V.check_lists(lists, queries, targets).collect()}
    assert got == {"duplicate_row": (1, "S1-1"), "duplicate_in_list": (1, "S1-1"), "self_match": (1, "S1-2"), "wrong_prefix": (1, "Q-1"), "missing_row": (1, "S1-2"), "extra_row": (1, "S1-9"), "unknown_target": (2, "Q-1,S1-2")}
    candidates = spark.createDataFrame([("S1-1", ["S2-7"])], "id string, items array<string>")
    assert V.check_subset(lists.limit(1), candidates).first().n == 1
    assert V.check_header("a,b", ("a", "b")) and not V.check_header("a\tb", ("a", "b")) and V.check_header("", ("a", "b"))


def test_order_check(spark):
    schema = "place long, id string, items array<string>"
    a = spark.createDataFrame([(0, "S1-1", ["S2-1"]), (1, "S1-2", [])], schema)
    b = spark.createDataFrame([(0, "S1-2", ["S2-1"]), (1, "S1-1", ["S2-1", "S2-2"])], schema)
    assert all(r.n == 0 for r in V.check_order(a, a, a, 1).collect())
    assert {r.rule: r.n for r in V.check_order(a, a, b, 1).collect()} == {"order_differs": 2, "over_cap": 1, "match_not_candidate": 0}


def test_logistic_models_reach_the_minimum_in_few_jobs(spark):
    """The gradient of the penalised loss by numpy is zero there; features of very different sizes, nearly separable."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4)) * [1, 50, 0.01, 3] + [0, 400, 0, 1]
    y = (x[:, 0] + 0.02 * (x[:, 1] - 400) + rng.normal(size=600) * 0.2 > 1).astype(int)
    names = ("a", "b", "c", "d")
    rows = spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y, x, strict=True)], "label int, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    spark.sparkContext.setJobGroup("fit", "fit")
    model = ML.fit(rows, "logistic", names)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    w = np.where(y == 1, 600 / (2 * y.sum()), 600 / (2 * (600 - y.sum())))
    beta = np.array(model.coefficients)
    p = 1 / (1 + np.exp(-(x @ beta + model.intercept)))
    slopes = np.append(x.T @ (w * (p - y)) + beta, (w * (p - y)).sum())
    assert np.abs(slopes).max() < 1e-3 and jobs < 40
    got = sorted(r.probability for r in model.transform(rows).collect())
    assert np.abs(np.array(got) - np.sort(p)).max() < 1e-8


def test_calibration_takes_every_row_of_a_large_class(spark):
    """The gradient over all 700,000 rows is zero, by numpy; a class thinned to 500,000 rows moves the intercept."""
    label = (F.col("id") % 7 == 0).cast("int").alias("label")
    rows = spark.range(700_000).select(label, (F.pmod(F.xxhash64("id"), F.lit(100)) / 200.0 + label * 0.3).alias("probability"))
    rows = rows.withColumns({"entity_id": F.lit("S1-1"), "candidate_id": F.monotonically_increasing_id().cast("string")})
    platt = ML.fit_platt(rows)
    seen = [(r.label, r.probability, r["count"]) for r in rows.groupBy("label", "probability").count().collect()]
    y, p, n = np.array(seen, dtype=float).T
    mean = n @ p / n.sum()
    assert abs(platt.mean - mean) < 1e-9 and abs(platt.scale - np.sqrt(n @ (p - mean) ** 2 / n.sum())) < 1e-9
    x = (p - mean) / platt.scale
    error = n * (1 / (1 + np.exp(-(platt.slope * x + platt.intercept))) - y)
    assert abs(error.sum()) < 0.1 and abs(error @ x + platt.slope) < 0.1
    assert ML.fit_platt(rows.filter("label = 1")).slope is None


def _training(spark):
    values = [(F.pmod(F.xxhash64(F.lit(f), "id"), F.lit(7)) / 6.0).alias(f) for f in PAIR_FEATURES]
    ids = F.concat(F.lit("S1-"), (F.col("id") % 20).cast("string")).alias("entity_id"), F.concat(F.lit("S2-"), F.col("id").cast("string")).alias("candidate_id")
    return staged(spark.range(300).select(*ids, (F.col("id") % 3 == 0).cast("int").alias("label"), *values))


def test_scores_of_several_models_need_no_join(spark, monkeypatch):
    rows = _training(spark)
    monkeypatch.setattr(catalogue, "training", lambda *_: rows)
    fits = {kind: ML.LogisticModel(PAIR_FEATURES[i : i + 1], (1.0,), 0.0) for i, kind in enumerate(("logistic", "logistic_source_specific", "boosted"))}
    monkeypatch.setattr(ML, "fit", lambda _, kind: fits[kind])
    found = catalogue.pair_model_scores(spark, "")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = rows.select("entity_id", "candidate_id", "label", *[F.round(1 / (1 + F.exp(-F.col(PAIR_FEATURES[i]))), 9).alias(k) for i, k in enumerate(fits)])
    assert found.columns == want.columns and found.count() == 300 and found.exceptAll(want).isEmpty()


def test_only_scores_are_moved_to_rerank(spark, monkeypatch):
    rows = _training(spark)
    monkeypatch.setattr(catalogue, "training", lambda *_: rows)
    first, second = ML.LogisticModel(PAIR_FEATURES[:1], (1.0,), 0.0), ML.LogisticModel(PAIR_FEATURES, tuple(i % 3 - 1.0 for i in range(len(PAIR_FEATURES))), 0.0)
    monkeypatch.setattr(ML, "fit", lambda *_: first)
    monkeypatch.setattr(ML, "fit_reranker", lambda _: second)
    found = catalogue.mlp_rerank(spark, "")
    moved = re.findall(r"\) Exchange\s+Input \[(\d+)\]", found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert moved and max(map(int, moved)) <= 5
    want = second.transform(ML.top_scored(first.transform(rows), 5)).select("entity_id", "candidate_id", "label", "probability")
    assert found.count() == want.count() == 100 and found.exceptAll(want).isEmpty()


def test_the_sample_of_some_folds_is_that_part_of_the_whole_sample(spark):
    names = ["name_char_similarity", "name_token_jaccard", "name_tfidf_cosine", "address_token_jaccard", "address_tfidf_cosine", "city_token_jaccard", "postal_code_match", "same_country", "name_core_exact", "address_exact"]
    pairs = spark.range(600).select(F.concat(F.lit("S1-"), (F.col("id") % 20).cast("string")).alias("entity_id"), F.concat(F.lit("S2-"), F.col("id").cast("string")).alias("candidate_id"), *[(F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(7)) / 6.0).alias(n) for n in names])
    truth = pairs.filter("cast(substr(candidate_id, 4) as int) < 15").select("entity_id", "candidate_id")
    fold = F.pmod(F.hash("entity_id"), F.lit(3))
    whole = N.sampled(N.labelled(pairs, truth).withColumn("fold", fold), 4)
    part = N.training_pairs(pairs.filter(fold != 1).withColumnRenamed("entity_id", "query_id"), truth.filter(fold != 1), 4)
    columns = ["entity_id", "candidate_id", "label"]
    mine = whole.filter("fold <> 1").select(columns)
    assert 0 < mine.count() == part.count() < pairs.filter(fold != 1).count() and mine.exceptAll(part.select(columns)).isEmpty()
