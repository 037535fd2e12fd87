"""Reports on errors, normalisation, drift, countries and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions import text as T
from affinis.operators import metrics as M
from affinis.operators import profile as P


def error_buckets(expected: Column, predicted: Column) -> Column:
    """Names of all rules that a pair of feature columns fulfils, in order; other_candidate if none."""
    c = F.col
    core, nj, aj = c("name_core_exact") == 1, c("name_token_jaccard"), c("address_token_jaccard")
    postal, house = c("postal_code_conflict") == 1, c("house_number_conflict") == 1
    char = c("name_char_similarity")
    rules = {
        "same_name_different_address": core & ((aj < 0.5) | postal | house), "same_address_different_name": ((c("address_exact") == 1) | (aj >= 0.8)) & (nj < 0.5),
        "franchise": core & (postal | house), "generic_name": core & (c("common_name_tokens") <= 1), "postal_conflict": postal, "house_conflict": house,
        "country_conflict": c("country_conflict") == 1, "normalization_collision": core & (c("name_exact") == 0),
        "graph_false_support": predicted & ~expected & (c("cross_source_support_count") > 0), "dba": expected & (c("name_variant_similarity") >= 0.8) & ~core,
        "typo": expected & (char >= 0.55) & (char < 0.95) & (nj > 0), "transliteration": expected & (c("name_tfidf_cosine") >= 0.35) & (char < 0.5) & (nj > 0),
        "missing_address": expected & (c("has_address_both") < 0.5), "missing_name": expected & (c("has_name_both") < 0.5),
        "address_reorder": expected & (aj >= 0.5) & (c("address_char_similarity") + 0.15 < aj),
        "city_extraction_failure": expected & (c("city_token_jaccard") == 0) & ((aj >= 0.5) | (c("postal_code_match") == 1)),
        "unseen_country_pattern": expected & (c("same_country") == 1) & (c("has_address_both") == 1) & (c("address_layout_country_plausibility") <= 0.1),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other_candidate")))


def bucket_report(rows: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Per bucket: pairs, tp, fp, fn, precision, recall, and the macro F0.5 if its errors were mended.

    rows: entity_id, candidate_id, expected, predicted (booleans), buckets. True pairs that no
    row holds make the bucket blocker_miss."""
    pair = ["entity_id", "candidate_id"]
    missed = truth.select(*pair).join(rows.select(*pair), pair, "left_anti")
    missed = missed.select(*pair, F.lit(True).alias("expected"), F.lit(False).alias("predicted"), F.array(F.lit("blocker_miss")).alias("buckets"))
    every = rows.select(*pair, "expected", "predicted", "buckets").unionByName(missed)
    e, p = F.col("expected"), F.col("predicted")

    def n(c: Column) -> Column:
        return F.sum(c.cast("long"))

    each = every.select("entity_id", "expected", "predicted", F.explode("buckets").alias("bucket"))
    stats = each.groupBy("bucket").agg(F.count("*").alias("pairs"), n(e & p).alias("tp"), n(p & ~e).alias("fp"), n(e & ~p).alias("fn"))
    totals = every.groupBy("entity_id").agg(n(e & p).alias("tp"), n(p).alias("predicted"), n(e).alias("actual"))
    totals = entities.select("entity_id").distinct().join(totals, "entity_id", "left").na.fill(0)
    now = M.entity_f05(F.col("tp"), F.col("predicted"), F.col("actual"))
    base = totals.agg(F.avg(now).alias("base"), F.count("*").alias("entities"))
    # mending a bucket changes only the entities that have errors in it
    wrong = each.groupBy("bucket", "entity_id").agg(n(p & ~e).alias("bfp"), n(e & ~p).alias("bfn")).filter("bfp + bfn > 0").join(totals, "entity_id")
    mended = M.entity_f05(F.col("tp") + F.col("bfn"), F.col("predicted") - F.col("bfp") + F.col("bfn"), F.col("actual"))
    gain = wrong.groupBy("bucket").agg(F.sum(mended - now).alias("gain"))
    out = stats.join(gain, "bucket", "left").join(F.broadcast(base))  # one row
    gained = F.coalesce(F.col("gain") / F.col("entities"), F.lit(0.0))

    def rate(a: str, b: str) -> Column:
        return F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0), 6)

    return out.select("bucket", "pairs", "tp", "fp", "fn", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"), F.round(F.col("base") + gained, 6).alias("score_if_fixed"), F.round(gained, 6).alias("impact"))


def collisions(records: DataFrame) -> DataFrame:
    """Normalised values of different raw texts, by field and country: records, raw_values, examples."""
    fields = F.explode(
        F.array(
            F.struct(F.lit("name").alias("field"), F.col("business_name").alias("raw"), T.core_name(F.col("business_name")).alias("key")),
            F.struct(F.lit("address").alias("field"), F.col("business_address").alias("raw"), T.normalise(F.col("business_address")).alias("key")),
        )
    ).alias("f")
    rows = records.select(T.normalise_country(F.col("country")).alias("country"), fields).select("country", "f.*").filter("key <> ''")
    raw = rows.groupBy("field", "country", "key", "raw").agg(F.count("*").alias("n"))  # repeats are added up first
    order = Window.partitionBy("field", "country", "key").orderBy("raw")
    first = F.collect_list(F.when(F.col("place") <= 5, F.col("raw")))
    groups = raw.withColumn("place", F.row_number().over(order)).groupBy("field", "country", "key").agg(F.sum("n").alias("records"), F.count("*").alias("raw_values"), F.array_join(F.sort_array(first), " | ").alias("examples"))
    return groups.filter("raw_values > 1")


def collision_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("field").agg(F.count("*").alias("collisions"), F.sum("records").alias("records"), F.max("raw_values").alias("most_raw_values"))


def audit(profiles: DataFrame) -> DataFrame:
    """How often each parsed field is there, per country."""

    def share(c: Column) -> Column:
        return F.round(F.avg(c.cast("double")), 6)

    named = {"city": "city_words", "state": "state_words", "postal": "postals", "unit": "units", "phone": "phones", "landmark": "landmarks"}
    return profiles.groupBy("country").agg(
        F.count("*").alias("records"), share(F.col("name_core") != "").alias("name"), share(F.col("house_number") != "").alias("house"),
        share(F.size("variants") > 1).alias("alias"), *[share(F.size(c) > 0).alias(n) for n, c in named.items()],
    )


def drift(scores: DataFrame) -> DataFrame:
    """Distribution of scores per data set and kind of score (columns dataset, score_type, score)."""
    return M.score_distribution(scores, "score", "dataset", "score_type")


def _hidden(names: tuple[str, ...], corrupt: bool) -> Column:
    mine = F.lit(True) if not names else T.normalise_country(F.col("country")).isin(*names)
    changed = F.when(F.coalesce("country", F.lit("")) == "", F.lit("unknown")).otherwise(F.concat("country", F.lit("x"))) if corrupt else F.lit("")
    return F.when(mine, changed).otherwise(F.col("country"))


def hide_country(records: DataFrame, names: tuple[str, ...], corrupt: bool = False) -> DataFrame:
    """Records with their country blanked, or misspelled, where it is one of names (all for none)."""
    return records.withColumn("country", _hidden(names, corrupt))


#: Scenarios of missing countries: which are hidden, and whether queries are misspelled instead.
SCENARIOS = {"france_hidden": (("france",), False), "us_india_hidden": (("us", "india"), False), "us_india_query_corrupted": (("us", "india"), True), "all_hidden": ((), False)}


def scenario_profiles(records: DataFrame, queries: Column) -> DataFrame:
    """Profiles of the records in all scenarios, and the names of those that each is for: a record is parsed once for
    each country that it gets. ``queries`` tells the records that are misspelled, where only queries are."""
    each = F.array(*[
        F.struct(F.lit(name).alias("scenario"), (F.when(queries, _hidden(names, True)).otherwise(F.col("country")) if corrupt else _hidden(names, False)).alias("country"))
        for name, (names, corrupt) in SCENARIOS.items()
    ])
    rows = records.withColumn("each", each).withColumn("country", F.explode(F.array_distinct(F.transform("each", lambda s: s["country"]))))
    mine = F.transform(F.filter("each", lambda s: s["country"].eqNullSafe(F.col("country"))), lambda s: s["scenario"])
    found = P.profile(rows.withColumn("entity_id", F.struct("entity_id", mine.alias("scenarios"))))
    return found.withColumns({"scenarios": F.col("entity_id.scenarios"), "entity_id": F.col("entity_id.entity_id")})


def model_comparison(folds: DataFrame) -> DataFrame:
    """Models by mean score over folds (columns model, fold, score), best first."""
    summed = folds.groupBy("model").agg(*[F.round(f("score"), 6).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max), ("std", F.stddev_pop))], F.count("*").alias("folds"))
    order = Window.orderBy(F.desc("mean"), "std", "model")  # one row per model
    return summed.withColumn("place", F.row_number().over(order).cast("long"))
