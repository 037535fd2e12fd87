"""Blocking, retrieval, graph and features on small records."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis import catalogue
from affinis.functions.constants import PAIR_FEATURES
from affinis.operators import blocking as B
from affinis.operators import features as FE
from affinis.operators import graph as G
from affinis.operators import metrics as M
from affinis.operators import profile as P
from affinis.operators import reports as RP
from affinis.operators import retrieval as R
from affinis.operators import search as SR
from affinis.operators import semantic as SE
from affinis.operators import thresholds as TH
from affinis.sources import staging
from affinis.sources import tables as TB
from affinis.sources.staging import staged

RECORD = "entity_id string, business_name string, business_address string, country string"


def profiles(spark, *rows):
    return staged(P.profile(spark.createDataFrame(list(rows), RECORD)))


def test_channels_unite_and_scopes_are_global(spark):
    q = profiles(spark, ("S1-1", "Blue Harbor", "4 Dock Road, 75001 Paris", "France"), ("S1-2", "", "", ""))
    t = profiles(spark, ("S2-a", "Blue Harbor", "9 Other Lane", "US"), ("S3-b", "Nothing Alike", "7 Quay, 75001 Lyon", "US"))
    found = R.retrieve(q, t)
    got = {r.candidate_id: r for r in found.collect()}
    assert set(got) == {"S2-a", "S3-b"}
    assert "name_exact" in got["S2-a"].channels and got["S3-b"].channels == ["address_token", "postal"]
    lists = {r.query_id: r.candidates for r in R.candidate_lists(q, found).collect()}
    assert lists["S1-2"] == []


def test_frequency_ceiling_drops_postings_but_not_counts(spark):
    t = profiles(spark, *[(f"S2-{i}", "Robert Store", "", "US") for i in range(6)])
    keys = B.keys(t)
    counted = B.key_frequencies(keys)
    assert counted.filter("channel = 'name_token' and value = 'robert' and scope = '*'").first().df == 6
    kept = {r.channel for r in B.postings(keys, counted, B.Blocking(max_frequency=1)).select("channel").distinct().collect()}
    assert "name_token" not in kept and "name_exact" not in kept  # 6 > 1 and 6 > 4


def test_phonetic_only_for_few_candidates(spark):
    q = profiles(spark, ("S1-1", "Bip", "", "US"))
    few = profiles(spark, ("S2-a", "Bub", "", "US"))
    assert [r.channels for r in R.retrieve(q, few).collect()] == [["name_phonetic"]]
    many = profiles(spark, ("S2-a", "Bub", "", "US"), *[(f"S2-{i}", "Bip", "", "US") for i in range(5)])
    assert "S2-a" not in {r.candidate_id for r in R.retrieve(q, many).collect()}


def test_semantic_fallback_and_its_cap(spark):
    q, t = profiles(spark, ("S1-1", "Bub", "", "US")), profiles(spark, ("S2-a", "Buc", "", "US"), ("S2-b", "Zzz", "", "US"))
    found = SE.neighbours(q, t)
    assert [r.candidate_id for r in found.collect()] == ["S2-a"]
    with pytest.raises(ValueError, match="more than 1"):
        SE.neighbours(q, t, max_rows=1)


def test_neighbours_of_copies_are_those_of_a_join_of_all_records(spark):
    """Names with many records, ties by id within and between them, against every record by itself."""
    words = ("Harbor", "Harbour", "Dock", "Docks", "Stone")
    q = profiles(spark, *[(f"S1-{i}", f"{words[i % 3]} Works", "", "US") for i in range(6)], ("S1-none", "", "", "US"))
    t = profiles(spark, *[(f"S2-{i:02}", f"{words[i % 5]} {('Works', 'Bay dba Harbor')[i % 2]}", "", "US") for i in range(40)])
    counted = SE.grams(t).withColumn("records", F.lit(1))
    vocab = staged(SE.vocabulary(counted, t.agg(F.count("*").alias("documents"))))
    of_query, of_target = ({(r.entity_id, r.gram): r.w for r in SE.weights(x, vocab).collect()} for x in (SE.grams(q), counted))
    want = set()
    for query in {k[0] for k in of_query}:
        sums = {}
        for (target, gram), w in of_target.items():
            sums[target] = sums.get(target, 0.0) + w * of_query.get((query, gram), 0.0)
        order = sorted((-round(v, 6), target) for target, v in sums.items() if v >= 0.12)[:7]
        want |= {(query, target, -v) for v, target in order}
    got = {(r.query_id, r.candidate_id, round(r.similarity, 6)) for r in SE.neighbours(q, t, top=7).collect()}
    assert got == want and len(got) == 42


def test_per_channel_context_counts_once_per_channel(spark):
    q, t = profiles(spark, ("S1-1", "Blue Harbor", "4 Dock Road", "US")), profiles(spark, ("S2-a", "Blue Harbor", "4 Dock Road", "US"))
    once, per = (R.retrieve(q, t, B.Blocking(context=m)).first() for m in ("once", "per_channel"))
    n = len(once.channels)
    import math

    assert per.score - once.score == pytest.approx((n - 1) * once.context - 0.5 * math.log(n), abs=1e-6)


def test_graph_links_directly_only(spark):
    t = profiles(spark, ("S2-a", "Acme Works", "5 Oak Road, 12345 Town", "US"), ("S3-a", "Acme Works", "5 Oak Road, 12345 Town", "US"), ("S2-b", "Acme Works", "77 Elm Street, 54321 City", "US"))
    found = G.edges(t)
    assert [(r.s2_id, r.s3_id, r.score) for r in found.collect()] == [("S2-a", "S3-a", 1.0)]
    assert {r.node: r.cluster_size for r in G.node_summaries(found).collect()} == {"S2-a": 2.0, "S3-a": 2.0}


def test_features_have_the_schema_and_are_never_null(spark):
    q = profiles(spark, ("S1-1", "Blue Harbor dba Red Dock", "12B Dock Road, Unit 4, Boston, MA 02101", "US"), ("S1-2", "", "", ""))
    t = profiles(spark, ("S2-a", "Red Dock Inc", "12A Dock Rd, Boston, MA 02101", "USA"), ("S3-b", "Blue Harbour", "", ""))
    pairs = R.retrieve(q, t)
    found = FE.pair_features(pairs, FE.weighted(q, t), FE.weighted(t, t))
    assert tuple(found.columns[2 : 2 + len(PAIR_FEATURES)]) == PAIR_FEATURES and len(PAIR_FEATURES) == 72
    rows = {r.candidate_id: r.asDict() for r in found.collect()}
    assert all(v is not None for r in rows.values() for v in r.values())
    a = rows["S2-a"]
    assert a["house_number_base_match"] == a["house_number_suffix_conflict"] == a["postal_code_match"] == a["state_match"] == 1.0
    assert a["name_variant_similarity"] == 1.0 and a["name_core_exact"] == 0.0 and a["house_number_match"] == 0.0


def test_truth_lists(spark, tmp_path):
    path = tmp_path / "truth.tsv"
    path.write_text('source1_entity_id\tmatched_entity_ids\nS1-1\tS2-9\nS1-2\t\nS1-1\tS2-1, S2-2,,S2-1\nS1-3\tNA\n')
    got = {(r.entity_id, r.candidate_id) for r in TB.read_truth(spark, str(path)).collect()}
    assert got == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-3", "NA")}


def test_cache_is_used_for_equal_settings_only(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for settings in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert TB.cached(spark, str(tmp_path), settings, build).count() == 3
    assert len(built) == 2


def test_artifact_settings_must_agree(tmp_path):
    path = str(tmp_path / "a.json")
    TB.save_artifact(path, {"k": 1}, {"boundary": 0.5})
    assert TB.load_artifact(path, {"k": 1}, ("boundary",)) == {"boundary": 0.5}
    for settings, required in (({"k": 2}, ()), ({"k": 1}, ("margin",))):
        with pytest.raises(ValueError):
            TB.load_artifact(path, settings, required)


def test_written_lists_keep_order(spark, tmp_path):
    rows = spark.createDataFrame([(0, "S1-b", ["S2-2", "S2-1"]), (1, "S1-a", [])], "place long, source1_entity_id string, items array<string>")
    TB.write_lists(rows, str(tmp_path / "m"), TB.MATCHES, "source1_entity_id", "items", "place")
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-b\tS2-2,S2-1\nS1-a\t\n"
    back = TB.read_lists(spark, str(tmp_path / "m")).orderBy(F.desc("id")).collect()
    assert [(r.id, r["items"]) for r in back] == [("S1-b", ["S2-2", "S2-1"]), ("S1-a", [])]


@pytest.mark.parametrize("how", [B.DEFAULT, B.Blocking(max_frequency=1), B.Blocking(context="per_channel", limit_multiplier=0.05), B.Blocking(max_frequency=0)])
def test_blocks_rank_as_pairs_do(spark, sf, how, monkeypatch):
    """Small blocks and short lists, against the plan with a row per pair."""
    monkeypatch.setattr(SR, "QUERIES", 40)
    monkeypatch.setattr(SR, "LIST", 50)
    queries, targets = catalogue.sides(spark, sf)
    columns = ["query_id", "candidate_id", "rank", F.round("score", 6).alias("score"), F.round("context", 6).alias("context"), "channels"]
    ours, theirs = (staged(f.select(*columns)) for f in (SR.by_blocks(queries, targets, how, 25, postings=20_000), R.retrieve_pairs(queries, targets, how)))
    assert ours.count() == theirs.count() > 0 and ours.exceptAll(theirs).isEmpty()
    assert SR.by_blocks(queries.limit(0), targets, how, 25).isEmpty() and SR.by_blocks(queries, targets.limit(0), how, 25).isEmpty()


def test_blocks_do_not_grow_with_what_queries_meet():
    """Tables of 900,000 queries whose index fits a block: 12 blocks, and not one for each 8,000,000 postings met."""
    assert SR.blocks_for(queries=900_000, met=18_000_000_000, index=14_400_000, cores=6) == 12
    assert SR.blocks_for(15_000, 300_000_000, 240_000, 6) == 6 and SR.blocks_for(0, 0, 0, 6) == 1
    assert SR.blocks_for(900_000, 18_000_000_000, 64_000_000, 6) > 500


def test_each_block_has_a_task_of_its_own(spark):
    """Numbers from 0 on would meet in some partitions, whose tasks then rank several blocks one after another."""
    for n in (1, 6, 12, 300):
        rows = spark.createDataFrame([(b,) for b in SR.labels(spark, n)], "block int").repartition(n, "block")
        assert sorted(r.p for r in rows.select(F.spark_partition_id().alias("p")).collect()) == list(range(n))


def test_scenarios_of_countries_are_parsed_once_for_each_country(spark, sf):
    """All scenarios' profiles at once, against each by itself."""
    records = catalogue.X.records(spark, sf, extra=True).withColumn("country", F.when(F.col("entity_id") != "X-02", F.col("country")))
    records = staged(records.filter("substr(entity_id, -1) in ('1', '2')"))
    every = staged(RP.scenario_profiles(records, F.col("entity_id").startswith("S1-")))
    assert records.count() < every.count() < 3 * records.count()
    for name, (countries, corrupt) in RP.SCENARIOS.items():
        mine = F.col("entity_id").startswith("S1-") if corrupt else F.lit(True)
        theirs = P.profile(RP.hide_country(records.filter(mine), countries, corrupt).unionByName(records.filter(~mine)))
        ours = every.filter(F.array_contains("scenarios", name)).drop("scenarios")
        assert ours.count() == records.count() and ours.select(theirs.columns).exceptAll(theirs).isEmpty()


def test_frequent_keys_and_words_rank_as_pairs_do(spark, sf, monkeypatch):
    """Nearly every key and word is frequent, so that what queries have in common comes from sums for all of them."""
    queries, targets = catalogue.sides(spark, sf)
    columns = ["query_id", "candidate_id", "rank", F.round("score", 6).alias("score"), F.round("context", 6).alias("context"), "channels"]
    monkeypatch.setattr(SR, "FREQUENT", 2)
    monkeypatch.setattr(SR, "ROWS", 100)
    ours, theirs = (staged(f(queries, targets, B.DEFAULT, 25).select(*columns)) for f in (SR.by_blocks, R.retrieve_pairs))
    assert ours.count() == theirs.count() > 0 and ours.exceptAll(theirs).isEmpty()


def test_blocks_round_as_sql_does(spark):
    """Halves go away from zero by their decimals, whatever lies below them in binary."""
    values = [0.00005, 1.00015, 2.675 / 10, 8.12345, -0.00005, -2.0000005, -3.1234565, -0.0000001, 0.0, 123.45675, *(i / 1e9 for i in range(-300_000_050, 300_000_050, 999_999))]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", F.round("v", 4).alias("four"), F.round("v", 6).alias("six")).collect()
    v = np.array([r.v for r in rows])
    for digits, name in ((4, "four"), (6, "six")):
        got = SR.half_up(v, digits)
        assert got.tolist() == [r[name] for r in rows] and not np.signbit(got[got == 0]).any()


def test_ranges_may_be_more_than_blocks(spark, monkeypatch):
    q = profiles(spark, *[(f"S1-{i}", f"Blue Harbor {i}", "4 Dock Road, 75001 Paris", "France") for i in range(9)])
    t = profiles(spark, *[(f"S2-{i}", f"Blue Harbor {i}", "9 Dock Lane, 75001 Paris", "France") for i in range(9)])
    want = staged(SR.by_blocks(q, t, B.DEFAULT, 0))
    by_range = type(q).repartitionByRange
    monkeypatch.setattr(type(q), "repartitionByRange", lambda rows, n, *by: by_range(rows, 50, *by))
    got = staged(SR.by_blocks(q, t, B.DEFAULT, 0))
    assert want.count() == got.count() == 81 and want.exceptAll(got).isEmpty()


def test_blocks_keep_no_keys_on_disk(spark, sf, tmp_path, monkeypatch):
    """What only leads to the postings lists and blocks is deleted when these are written."""
    queries, targets = catalogue.sides(spark, sf)
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(staging, "_INNER", [])
    SR.by_blocks(queries, targets, B.DEFAULT, 0, give="contexts")
    columns = [set(spark.read.parquet(str(d)).columns) for d in tmp_path.iterdir() if any(d.iterdir())]
    assert len(columns) == 3 and not any(c in ({"entity_id", "channel", "key"}, {"entity_id", "ids", "size"}) for c in columns)


@pytest.mark.parametrize("frequent", [SR.FREQUENT, 2])
def test_blocks_give_scores_contexts_and_channels_as_pairs_do(spark, frequent, monkeypatch):
    """All pairs without a row of a join, the phonetic channel of a query with few candidates included."""
    monkeypatch.setattr(SR, "FREQUENT", frequent)
    words = ("Harbor", "Dock", "Blue", "Red", "Stone")
    q = profiles(spark, ("S1-x", "Bip", "", "US"), ("S1-none", "", "", ""), *[(f"S1-{i}", f"{words[i % 5]} {words[i % 3]} Works", f"{i} Dock Road, 7500{i % 3} Paris", "France") for i in range(12)])
    t = profiles(spark, ("S2-x", "Bub", "", "US"), *[(f"S2-{i}", f"{words[i % 5]} {words[i % 4]} Works", f"{i % 9} Dock Road, 7500{i % 4} Paris", ("France", "US")[i % 2]) for i in range(60)])
    how = B.Blocking(limit_multiplier=0.05)
    keys = B.keys(t, how)
    posted = B.postings(keys, B.key_frequencies(keys), how)
    plain = staged(R.channel_scores(B.keys(q, how).filter("channel <> 'name_phonetic'"), posted, F.lit(61), how))
    phonetic = R.channel_scores(B.keys(q.filter("entity_id = 'S1-x'"), how).filter("channel = 'name_phonetic'"), posted, F.lit(61), how)
    every = staged(plain.unionByName(phonetic))
    contexts = staged(R.with_context(every, q, t))
    top = R.channel_top(every, contexts, how)
    for give, theirs in (("scores", plain), ("contexts", contexts), ("selected", top)):
        rounded = [F.round(c, 6).alias(c) if c in ("score", "context") else F.col(c).cast("string") for c in theirs.columns]
        ours, theirs = (staged(f.select(*rounded)) for f in (SR.by_blocks(q, t, how, 0, give=give), theirs))
        assert ours.count() == theirs.count() > 0 and ours.exceptAll(theirs).isEmpty()
    assert top.filter("channel = 'name_phonetic'").count() == 1


def test_features_of_slices_are_those_of_all_pairs(spark, sf, monkeypatch):
    """Slices and single features, against one join of all profiles; what was staged for a table goes when it is written."""
    monkeypatch.setattr(staging, "_MADE", dict(staging._MADE))
    queries, targets = catalogue.sides(spark, sf)
    pairs = catalogue.ranked(spark, sf)
    whole = staged(FE.pair_features(pairs, *catalogue.X.split(FE.weighted(queries.unionByName(targets), targets))))
    rounded = {c: F.round(c, 9) for c in whole.columns[2:]}
    monkeypatch.setattr(catalogue, "SLICE", 2000)
    kept, before = [], {f.name for f in Path(_folder(spark)).iterdir()}
    for only in (("name_jaro_winkler",), ("address_tfidf_cosine", "address_layout_country_plausibility"), ()):
        got = catalogue.pair_features(spark, sf, *only)
        columns = ["query_id", "candidate_id", *(only or whole.columns[2:])]
        assert got.columns == columns and got.count() == whole.count() > 200
        assert got.withColumns({c: rounded[c] for c in columns[2:]}).exceptAll(whole.withColumns(rounded).select(columns)).isEmpty()
        kept.append(got)
    assert len({f.name for f in Path(_folder(spark)).iterdir()} - before) == len(kept)


def test_steps_of_a_shared_table_are_deleted_and_the_tables_that_it_is_made_from_stay(spark):
    steps = []

    def build():
        shared = staging.once(spark, ("test", "shared"), lambda: spark.range(3))
        steps.append(staging.staged(shared))
        yield steps[0].filter("id < 2")
        yield steps[0].filter("id = 2")

    found = staging.once(spark, ("test", "made"), build)
    assert sorted(r.id for r in found.collect()) == [0, 1, 2]
    assert not Path(steps[0].inputFiles()[0].removeprefix("file://")).exists()
    assert staging.once(spark, ("test", "shared"), None).count() == 3
    kept = staging.staged(spark.range(2))
    assert kept.count() == 2
    staging.drop(kept)
    assert not Path(kept.inputFiles()[0].removeprefix("file://")).exists()


def test_shuffle_files_go_with_the_part_that_they_were_made_for(spark, monkeypatch):
    """Without waiting for the driver's garbage collection, which comes late or not before the next part is written."""
    monkeypatch.setattr(staging, "_free", lambda spark: None)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in manager.getAllFiles().mkString("\n").splitlines() if "/shuffle_" in f}

    before, setting = files(), spark.conf.get(staging.CLEANUP, None)
    parts = [spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count() for _ in range(2)]
    made = staging.staged_parts(spark, parts)
    assert not files() - before and spark.conf.get(staging.CLEANUP, None) == setting
    assert made.agg(F.sum("count")).first()[0] == 2000 and sorted(r["count"] for r in parts[0].collect()) == [142] * 1 + [143] * 6


def test_entity_features_and_training_pairs_of_slices(spark, sf, monkeypatch):
    """Slice by slice, against all pairs at once."""
    monkeypatch.setattr(staging, "_MADE", dict(staging._MADE))
    monkeypatch.setattr(catalogue, "SLICE", 2000)
    ours, all_pairs = catalogue.entity_feature_table(spark, sf), catalogue.pair_features(spark, sf)
    assert not staging.has(spark, ("features", sf, "rank")) and len(list(catalogue._slices(spark, sf, ("rank",)))) == 2
    rows = all_pairs.join(catalogue.ranked(spark, sf).select("query_id", "candidate_id", "rank"), ["query_id", "candidate_id"]).withColumnRenamed("query_id", "entity_id")
    p = F.round(0.6 * F.col("name_token_jaccard") + 0.4 * F.col("address_token_jaccard"), 9)
    theirs = catalogue.E.entity_features(catalogue.sides(spark, sf)[0], rows.withColumns({"probability": p, "calibrated": p}), 0.5)
    ours, theirs = (x.select("entity_id", *[F.round(c, 6).alias(c) for c in x.columns[1:]]) for x in (ours, theirs))
    assert ours.count() == theirs.count() > 0 and ours.exceptAll(theirs).isEmpty()
    sampled, once = catalogue.training(spark, sf), catalogue.N.training_pairs(all_pairs, catalogue.X.truth(spark, sf), 6)
    pair = ["entity_id", "candidate_id", "label"]
    assert sampled.count() == once.count() > 0 and sampled.select(pair).exceptAll(once.select(pair)).isEmpty()


def _folder(spark):
    return staging.shared_dir(spark).removeprefix("file://").removeprefix("file:")


def test_channel_recall_moves_each_pair_once(spark):
    """Pairs are not copied for each of their channels before they meet the truth."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    queries = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    selected = spark.createDataFrame([("S1-1", "S2-1", ["name_token", "postal"]), ("S1-1", "S2-2", ["postal"]), ("S1-2", "S2-1", [])], "query_id string, candidate_id string, channels array<string>")
    found = M.channel_recall(queries, selected, spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-9")], "entity_id string, candidate_id string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.adaptive.enabled")
    depth = {kind: [line.index(kind) for line in plan if kind in line] for kind in ("Generate explode", "LeftOuter, ((query_id")}
    assert max(depth["Generate explode"]) < min(depth["LeftOuter, ((query_id"])
    got = {r.channel: (r.candidates, r.hits, r.mean_size) for r in found.collect()}
    assert got["postal"] == (2, 1, 1.0) and got["name_token"] == (1, 1, 0.5) and got["city_token"] == (0, 0, 0.0) and len(got) == 10


def test_running_sums_over_ranges(spark):
    rows = [(g, i * 7 % 100, float(i)) for g in ("a", "b") for i in range(100)]
    frame = spark.createDataFrame(rows, "g string, k int, v double")
    got = {(r.g, r.k): r.t for r in TH.running_sums(frame, "k", {"v": "t"}, ("g",)).collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j <= k) for g, k, _ in rows}


def test_queries_that_the_linkage_is_trained_on_are_retrieved_once(spark, sf, monkeypatch):
    """And their matches are those that ``match`` finds; retrieval, features and models stand in."""
    L, calls = catalogue.L, []
    ranked = spark.createDataFrame([(f"S1-{k}", f"S2-{k + d}", d + 1) for k in range(1, 9) for d in range(3)], "query_id string, candidate_id string, rank int")
    values = {c: (1.0 / F.col("rank")).alias(c) for c in L.SCORED[3:]}

    def candidates(queries, prepared, config):
        calls.append(queries)
        return None, ranked

    fitted = L.Fitted(L.ML.LogisticModel(("postal_code_match",), (4.0,), -3.0), L.ML.Platt(), 0.5, None, 0.0)
    monkeypatch.setattr(L, "prepare", lambda *a: None)
    monkeypatch.setattr(L, "candidates", candidates)
    monkeypatch.setattr(L, "features", lambda profiles, ranked, prepared, carried=("rank",): ranked.select(F.col("query_id").alias("entity_id"), "candidate_id", *carried, *values.values()))
    monkeypatch.setattr(L, "fit", lambda pairs, *a: (fitted, pairs))
    monkeypatch.setattr(L, "fit_gate", lambda oof, queries, truth, fitted: fitted)
    matches = catalogue.linkage_end_to_end(spark, sf)
    assert len(calls) == 1
    again = L.match(calls[0], None, fitted)[1]
    got = sorted((r.entity_id, r.candidate_id) for r in matches.collect())
    assert got == [(f"S1-{k}", f"S2-{k}") for k in range(1, 9)] == sorted((r.entity_id, r.candidate_id) for r in again.collect())
