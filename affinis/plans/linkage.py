"""The linkage from records to matches: profiles, candidates, features, scores, decision."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.constants import ENTITY_FEATURES
from affinis.functions.text import Normalisation
from affinis.operators import blocking as B
from affinis.operators import entity_features as E
from affinis.operators import features as FE
from affinis.operators import graph as G
from affinis.operators import metrics as M
from affinis.operators import profile as P
from affinis.operators import retrieval as R
from affinis.operators import sampling as N
from affinis.operators import semantic as SE
from affinis.operators import thresholds as TH
from affinis.operators import validate as V
from affinis.plans import models as ML
from affinis.sources import tables as S
from affinis.sources.staging import drop, staged, staged_parts

#: Ranked pairs whose profiles meet at once; more are taken in slices by query, so that the wide rows of one slice lie on disk.
SLICE = 2_000_000


@dataclass(frozen=True)
class Config:
    blocking: B.Blocking = field(default_factory=B.Blocking)
    normalisation: Normalisation = field(default_factory=Normalisation)
    model: str = "logistic"
    rerank: int = 0
    max_candidates: int = 25
    negatives: int = 20
    adversarial: int = 5
    folds: int = 5
    graph: bool = True
    semantic: bool = False
    seed: int = 42

    def settings(self) -> dict:
        return asdict(self)


@dataclass
class Prepared:
    """Targets that queries are matched against, prepared once."""

    profiles: DataFrame
    weighted: DataFrame
    edges: DataFrame | None


def prepare(targets: DataFrame, config: Config = Config()) -> Prepared:
    profiles = staged(P.profile(targets, config.normalisation))
    edges = staged(G.edges(profiles)) if config.graph else None
    return Prepared(profiles, staged(FE.weighted(profiles, profiles)), edges)


def candidates(queries: DataFrame, prepared: Prepared, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Profiles of the queries and their ranked candidates."""
    profiles = staged(P.profile(queries, config.normalisation))
    semantic = SE.fallback(profiles, prepared.profiles) if config.semantic else None
    return profiles, staged(R.retrieve(profiles, prepared.profiles, config.blocking, config.max_candidates, semantic))


def features(profiles: DataFrame, ranked: DataFrame, prepared: Prepared, carried: tuple[str, ...] = ("rank",)) -> DataFrame:
    """entity_id, candidate_id, the carried columns and the pair features, staged slice by slice."""
    n = max(1, -(-ranked.count() // SLICE))

    def part(rows: DataFrame, of: str, i: int) -> DataFrame:
        return rows.filter(F.pmod(F.xxhash64(of), F.lit(n)) == i) if n > 1 else rows

    def slices():
        summaries = staged(G.node_summaries(prepared.edges)) if prepared.edges is not None else None
        for i in range(n):
            mine = part(ranked, "query_id", i)
            support = G.candidate_support(mine, prepared.edges) if prepared.edges is not None else None
            weighted = staged(FE.weighted(part(profiles, "entity_id", i), prepared.profiles))
            yield FE.pair_features(mine, weighted, prepared.weighted, summaries, support, carried=carried).withColumnRenamed("query_id", "entity_id")
            drop(weighted)
        if summaries is not None:
            drop(summaries)

    return staged_parts(ranked.sparkSession, slices())


@dataclass
class Fitted:
    model: object
    platt: ML.Platt
    boundary: float | None
    margin: float | None
    score: float
    gate: object | None = None
    gate_boundary: float | None = None


#: What scored pairs keep for the decision and the gate.
SCORED = ("entity_id", "candidate_id", "rank", *E.OF_PAIRS)


def out_of_fold(pairs: DataFrame, sample: DataFrame, config: Config) -> DataFrame:
    """Scores of each fold by a model that has not seen it: entity_id, candidate_id, rank, label, fold, probability and what entity features need.

    pairs and their sample have label and fold. The sample of an entity depends on no other, so that of all folds but one is a part of the whole one."""

    def scored():
        for k in range(config.folds):
            model = ML.fit(sample.filter(F.col("fold") != k), config.model)
            yield model.transform(pairs.filter(F.col("fold") == k)).select(*SCORED, "label", "fold", "probability")

    return staged_parts(pairs.sparkSession, scored())


def decide(oof: DataFrame, entities: DataFrame, truth: DataFrame, holdout: int = 0) -> tuple[ML.Platt, tuple]:
    """Calibration and threshold on all folds but the one held out."""
    inside = oof.filter(F.col("fold") != holdout)
    platt = ML.fit_platt(inside)
    scored = inside.withColumn("probability", platt.apply(F.col("probability")))
    actual = M.entity_counts(entities, truth.limit(0), truth).select("entity_id", "actual")
    tuned = actual.join(inside.select("entity_id").distinct(), "entity_id", "left_semi")
    return platt, TH.choose(TH.sweep(scored, staged(tuned)))


def train(queries: DataFrame, targets: DataFrame, truth: DataFrame, config: Config = Config()) -> tuple[Prepared, Fitted, DataFrame]:
    """Prepared targets, the fitted decision and the out-of-fold scores."""
    prepared = prepare(targets, config)
    _, pairs = labelled_pairs(queries, prepared, truth, config)
    return prepared, *fit(pairs, queries, truth, config)


def labelled_pairs(queries: DataFrame, prepared: Prepared, truth: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates, and the pairs with rank, label, fold and features."""
    profiles, ranked = candidates(queries, prepared, config)
    folds = N.folds(queries, truth, config.folds, config.seed).select("entity_id", "fold")
    marked = N.labelled(ranked.withColumnRenamed("query_id", "entity_id"), truth).join(folds, "entity_id").withColumnRenamed("entity_id", "query_id")
    return ranked, features(profiles, staged(marked), prepared, ("rank", "label", "fold"))


def fit(pairs: DataFrame, queries: DataFrame, truth: DataFrame, config: Config = Config()) -> tuple[Fitted, DataFrame]:
    """The decision fitted on labelled pairs, and their out-of-fold scores."""
    sample = staged(N.sampled(pairs, config.negatives, config.seed))
    oof = out_of_fold(pairs, sample, config)
    platt, (boundary, margin, score) = decide(oof, queries, truth)
    if config.adversarial:
        pair = ["entity_id", "candidate_id"]
        first = ML.fit(sample, config.model)
        scored = first.transform(pairs).select(*pair, "probability", N.category().alias("category"))
        mined = staged(N.adversarial_negatives(scored, truth, sample, config.adversarial, config.seed).select(*pair))
        sample = sample.unionByName(pairs.join(mined, pair, "left_semi").select(*sample.columns))
    return Fitted(ML.fit(sample, config.model), platt, boundary, margin, score), oof


def fit_gate(oof: DataFrame, entities: DataFrame, truth: DataFrame, fitted: Fitted, holdout: int = 0) -> Fitted:
    """Adds a gate on entity features, if it raises the score on the fold it is tuned on."""
    scored = oof.withColumn("calibrated", fitted.platt.apply(F.col("probability")))
    last = oof.agg(F.max("fold")).first()[0]
    rows = staged(E.entity_features(entities, scored, fitted.boundary or 0.0))
    linked = truth.select("entity_id").distinct().withColumn("label", F.lit(1))
    rows = rows.join(linked, "entity_id", "left").na.fill(0, ["label"]).join(oof.select("entity_id", "fold").distinct(), "entity_id")
    rows = staged(rows.withColumn("candidate_id", F.lit("")))
    gate = ML.fit(rows.filter((F.col("fold") != holdout) & (F.col("fold") != last)), "logistic", ENTITY_FEATURES)
    tune = gate.transform(rows.filter(F.col("fold") == last)).select("entity_id", "probability")
    decided = TH.predictions(scored.filter(F.col("fold") == last).withColumn("probability", F.col("calibrated")), fitted.boundary, fitted.margin)
    counts = staged(M.entity_counts(tune, decided.select("entity_id", "candidate_id"), truth.join(tune, "entity_id", "left_semi")))
    points = TH.gate_points(tune, counts)
    boundary, score = TH.choose_step(points)
    plain = points.filter("boundary is null").first().score
    if score > plain:
        fitted.gate, fitted.gate_boundary = gate, boundary
    return fitted


def match(queries: DataFrame, prepared: Prepared, fitted: Fitted, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Candidates (ranked) and matches (entity_id, candidate_id, probability) of all queries in one plan."""
    profiles, ranked = candidates(queries, prepared, config)
    return ranked, decided(queries, features(profiles, ranked, prepared), fitted)


def decided(queries: DataFrame, pairs: DataFrame, fitted: Fitted) -> DataFrame:
    """Matches among the pairs of queries."""
    scored = staged(fitted.model.transform(pairs).select(*SCORED, "probability").withColumn("calibrated", fitted.platt.apply(F.col("probability"))))
    found = TH.predictions(scored.withColumn("probability", F.col("calibrated")), fitted.boundary, fitted.margin)
    if fitted.gate is not None:
        rows = E.entity_features(queries, scored, fitted.boundary or 0.0).withColumn("candidate_id", F.lit(""))
        through = fitted.gate.transform(rows)
        through = through.filter(F.col("probability") > fitted.gate_boundary) if fitted.gate_boundary is not None else through
        found = found.join(through.select("entity_id"), "entity_id", "left_semi")
    return found.select("entity_id", "candidate_id", "probability")


def rule_matches(ranked: DataFrame, least: float = 0.5) -> DataFrame:
    """Without a model: candidates whose score is at least this share of their query's best, and that
    agree with it on more than one channel."""
    from pyspark.sql import Window

    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = ranked.withColumn("best", best).filter((F.col("score") >= least * F.col("best")) & (F.size("channels") >= 4))
    return rows.select(F.col("query_id").alias("entity_id"), "candidate_id", "score")


def lists(queries: DataFrame, ranked: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per query: place, source1_entity_id, candidates in rank order and matches sorted by id."""
    placed = queries.select(F.monotonically_increasing_id().alias("place"), F.col("entity_id").alias("query_id"))
    found = matches.groupBy(F.col("entity_id").alias("query_id")).agg(F.sort_array(F.collect_set("candidate_id")).alias("matches"))
    none = F.array().cast("array<string>")
    rows = placed.join(R.candidate_lists(queries, ranked), "query_id").join(found, "query_id", "left")
    return rows.select("place", F.col("query_id").alias("source1_entity_id"), "candidates", F.coalesce("matches", none).alias("matches"))


def write(found: DataFrame, out: str) -> None:
    S.write_lists(found, f"{out}/matching_results", S.MATCHES, "source1_entity_id", "matches", "place")
    S.write_lists(found, f"{out}/candidate_pairs", S.CANDIDATES, "source1_entity_id", "candidates", "place")


def main(argv: list[str] | None = None) -> int:
    """Trains on one folder (source1..3.tsv, ground_truth.tsv), matches another, writes and validates."""
    parser = argparse.ArgumentParser(prog="affinis")
    parser.add_argument("--train", required=True)
    parser.add_argument("--test", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--stage", choices=("retrieval", "calibration", "match"), default="match")
    parser.add_argument("--model", default="logistic")
    parser.add_argument("--folds", type=int, default=5)
    parser.add_argument("--max-candidates", type=int, default=25)
    parser.add_argument("--max-frequency", type=int, default=10_000)
    parser.add_argument("--limit-multiplier", type=float, default=1.0)
    parser.add_argument("--ngrams", type=int, default=6)
    parser.add_argument("--context", choices=("once", "per_channel"), default="once")
    parser.add_argument("--negatives", type=int, default=20)
    parser.add_argument("--adversarial", type=int, default=5)
    parser.add_argument("--no-graph", action="store_true")
    parser.add_argument("--semantic", action="store_true")
    parser.add_argument("--seed", type=int, default=42)
    a = parser.parse_args(argv)
    if a.folds < 2 or a.max_candidates < 0 or a.max_frequency < 0 or a.limit_multiplier <= 0:
        parser.error("folds must be 2 or more, limits not negative, and the multiplier positive")
    config = Config(B.Blocking(a.max_frequency, a.limit_multiplier, a.ngrams, a.context), Normalisation(), a.model, 0, a.max_candidates, a.negatives, a.adversarial, a.folds, not a.no_graph, a.semantic, a.seed)
    spark = SparkSession.builder.getOrCreate()
    source = {(d, n): S.read_records(spark, f"{getattr(a, d)}/source{n}.tsv") for d in ("train", "test") for n in (1, 2, 3)}
    truth = S.read_truth(spark, f"{a.train}/ground_truth.tsv")
    Path(a.out).mkdir(parents=True, exist_ok=True)
    if a.stage == "retrieval":
        prepared = prepare(S.union_targets(source["train", 2], source["train", 3]), config)
        _, ranked = candidates(source["train", 1], prepared, config)
        report = [r.asDict() for r in M.recall_at(ranked, truth, source["train", 1]).collect()]
        Path(a.out, "retrieval.json").write_text(json.dumps(report))
        return 0
    prepared, fitted, oof = train(source["train", 1], S.union_targets(source["train", 2], source["train", 3]), truth, config)
    values = {"boundary": fitted.boundary, "margin": fitted.margin, "score": fitted.score, "platt": asdict(fitted.platt)}
    S.save_artifact(f"{a.out}/calibration.json", json.loads(json.dumps(config.settings())), values)
    if a.stage == "calibration":
        return 0
    fitted = fit_gate(oof, source["train", 1], truth, fitted)
    targets = S.union_targets(source["test", 2], source["test", 3])
    ranked, matches = match(source["test", 1], prepare(targets, config), fitted, config)
    found = staged(lists(source["test", 1], ranked, matches))
    write(found, a.out)
    ids = found.select(F.col("source1_entity_id").alias("id"), "place", "matches", "candidates")
    findings = V.validate(ids.select("id", F.col("matches").alias("items")), ids.select("id", F.col("candidates").alias("items")), source["test", 1], targets)
    wrong = findings.filter("n > 0 and severity = 'error'").collect()
    Path(a.out, "validation.json").write_text(json.dumps([r.asDict() for r in wrong]))
    return 1 if wrong else 0


if __name__ == "__main__":
    raise SystemExit(main())
