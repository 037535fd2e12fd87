"""The 72 features of a candidate pair, in one projection over joined profiles.

Word weights (idf) are joined to the profiles before these meet in pairs, as maps from word
to weight, so pairs need no further join for them. Edit similarities, which no built-in
expresses, come from one Arrow UDF per pair.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions import similarity as S
from affinis.functions.constants import CHANNELS, PAIR_FEATURES
from affinis.functions.text import char_ngrams
from affinis.operators import blocking as B
from affinis.operators import graph as G


#: Features that need more of a record than its profile, and what that is.
WEIGHTS = {
    "name_tfidf_cosine": "variant_tfidf", "name_rare_token_overlap": "name_idf", "address_tfidf_cosine": "address_tfidf", "address_rare_token_overlap": "address_idf",
    "address_layout_country_plausibility": "layout_share", "postal_country_pattern_support": "postal_shares",
}


def weighted(profiles: DataFrame, targets: DataFrame, columns: Collection[str] = tuple(WEIGHTS.values())) -> DataFrame:
    """profiles with maps of idf and of tf-idf weights, and the shares of their layout and postal
    lengths among the target records of their country; of these, what ``columns`` need."""
    n = targets.agg(F.count("*").alias("documents"))
    out = profiles.join(F.broadcast(n))
    for words, frequencies, name in (("name_words", B.name_frequencies(targets), "name"), ("address_words", B.address_frequencies(targets), "address")):
        if {f"{name}_idf", f"{name}_tfidf"} & {*columns}:
            out = _with_idf(out, words, frequencies, name)
    if "variant_tfidf" in columns:
        out = _with_variant_weights(out, B.name_frequencies(targets))
    return _with_plausibility(out, targets) if {"layout_share", "postal_shares"} & {*columns} else out


def _with_idf(rows: DataFrame, words: str, frequencies: DataFrame, name: str) -> DataFrame:
    """Adds <name>_idf: map word -> idf, and <name>_tfidf: map word -> (1 + ln tf) idf."""
    each = rows.select("entity_id", "documents", F.explode(words).alias("word")).groupBy("entity_id", "documents", "word").agg(F.count("*").alias("tf"))
    each = each.join(frequencies, "word", "left").withColumn("idf", S.idf(F.col("df"), F.col("documents")))
    entry = F.struct("word", "idf")
    entry2 = F.struct("word", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    maps = each.groupBy("entity_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(f"{name}_idf"), F.map_from_entries(F.sort_array(F.collect_list(entry2))).alias(f"{name}_tfidf")
    )
    none = F.create_map().cast("map<string,double>")
    return rows.join(maps, "entity_id", "left").withColumns({c: F.coalesce(c, none) for c in (f"{name}_idf", f"{name}_tfidf")})


def _with_variant_weights(rows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Adds variant_tfidf: one weight map per name variant."""
    each = rows.select("entity_id", "documents", F.posexplode("variants").alias("place", "variant")).select("entity_id", "documents", "place", F.explode(F.split("variant", " ")).alias("word"))
    each = each.groupBy("entity_id", "documents", "place", "word").agg(F.count("*").alias("tf")).join(frequencies, "word", "left")
    entry = F.struct("word", ((1.0 + F.log("tf")) * S.idf(F.col("df"), F.col("documents"))).alias("w"))
    maps = each.groupBy("entity_id", "place").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("m"))
    maps = maps.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.map_entries("m").alias("m")))), lambda x: F.map_from_entries(x["m"])).alias("variant_tfidf"))
    return rows.join(maps, "entity_id", "left").withColumn("variant_tfidf", F.coalesce("variant_tfidf", F.array().cast("array<map<string,double>>")))


def smoothed(n: Column, total: Column, kinds: Column) -> Column:
    """Share of a kind with one added to each count; an unseen kind counts as one more."""
    seen = F.coalesce(n, F.lit(0))
    return F.when(F.coalesce(total, F.lit(0)) > 0, (seen + 1) / (total + kinds + F.when(n.isNull(), 1).otherwise(0))).otherwise(F.lit(0.0))


def _with_plausibility(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds layout_share (null without a country) and postal_shares (array)."""

    def totals(counts: DataFrame) -> DataFrame:
        return counts.groupBy("country").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))

    layouts, lengths = B.layout_counts(targets), B.postal_length_counts(targets)
    found = rows.select("entity_id", "country", "layout").filter("country <> ''").join(layouts, ["country", "layout"], "left").join(totals(layouts), "country", "left")
    layout = found.select("entity_id", smoothed(F.col("n"), F.col("total"), F.col("kinds")).alias("layout_share"))
    codes = rows.filter("country <> ''").select("entity_id", "country", F.explode("postals").alias("code")).withColumn("digits", F.length("code"))
    codes = codes.join(lengths, ["country", "digits"], "left").join(totals(lengths), "country", "left")
    postal = codes.groupBy("entity_id").agg(F.sort_array(F.collect_list(smoothed(F.col("n"), F.col("total"), F.col("kinds")))).alias("postal_shares"))
    out = rows.join(layout, "entity_id", "left").join(postal, "entity_id", "left")
    return out.withColumn("postal_shares", F.coalesce("postal_shares", F.array().cast("array<double>")))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _best(a: Column, b: Column, similarity) -> Column:
    """The largest similarity of two arrays' items; 0 if either is empty."""
    every = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: similarity(x, y))))
    return F.coalesce(F.array_max(every), F.lit(0.0))


def _mean(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda s, v: s + v) / F.size(items)).otherwise(F.lit(0.0))


def pair_features(candidates: DataFrame, queries: DataFrame, targets: DataFrame, summaries: DataFrame | None = None, support: DataFrame | None = None, only: Collection[str] = (), carried: Collection[str] = ()) -> DataFrame:
    """query_id, candidate_id and the features, for ranked candidates (query_id, candidate_id,
    rank, channels). ``queries`` and ``targets`` are weighted profiles; ``summaries`` and
    ``support`` come from the graph of the targets, and are taken as empty if absent. ``only``: the
    features wanted, or rank; what just the others need isn't read or moved. ``carried``: columns of
    the candidates that come along."""
    q = queries.select(F.col("entity_id").alias("query_id"), F.struct(*[c for c in queries.columns if c != "documents"]).alias("q"))
    t = targets.select(F.col("entity_id").alias("candidate_id"), F.struct(*[c for c in targets.columns if c != "documents"]).alias("t"))
    pairs = candidates.select("query_id", "candidate_id", *dict.fromkeys(("rank", "channels", *carried)))
    if support is not None:  # while rows are narrow
        pairs = pairs.join(support, ["query_id", "candidate_id"], "left")
    pairs = pairs.join(q, "query_id").join(t, "candidate_id")
    if summaries is not None:
        pairs = pairs.join(summaries.select(F.col("node").alias("candidate_id"), F.struct(*[c for c in summaries.columns if c != "node"]).alias("g")), "candidate_id", "left")
    a, b = F.col("q"), F.col("t")
    addresses = [x["address_raw"] if not only or "address_char_similarity" in only else F.lit("") for x in (a, b)]
    pairs = pairs.withColumn("edit", S.edit_similarities(a["variants"], b["variants"], *addresses))
    e = F.col("edit")
    shared = {
        "nj": S.jaccard(a["name_words"], b["name_words"]), "aj": S.jaccard(a["address_words"], b["address_words"]), "cj": S.jaccard(a["city_words"], b["city_words"]),
        "postal": S.overlap(a["postals"], b["postals"]), "base": (a["house_base"] != "") & (a["house_base"] == b["house_base"]),
        "known": (a["country"] != "") & (b["country"] != ""), "differs": (a["country"] != "") & (b["country"] != "") & (a["country"] != b["country"]),
        "name_grams": F.struct(char_ngrams(a["name_core"]).alias("a"), char_ngrams(b["name_core"]).alias("b")),
        "address_grams": F.struct(char_ngrams(a["address_raw"]).alias("a"), char_ngrams(b["address_raw"]).alias("b")),
    }
    pairs = pairs.withColumns(shared)
    nj, aj, cj, postal, base, known, differs = (F.col(c) for c in ("nj", "aj", "cj", "postal", "base", "known", "differs"))
    ng, ag = F.col("name_grams"), F.col("address_grams")
    if only:
        grams = {f"{x}_{how}": f(g["a"], g["b"]) for x, g in (("name", ng), ("address", ag)) for how, f in (("jaccard", S.jaccard), ("cosine", S.set_cosine))}
    else:  # the names and addresses are compared in Python in any case
        grams = {f"{x}_{how}": e[f"{x}_gram_{how}"] for x in ("name", "address") for how in ("jaccard", "cosine")}

    def both(field: str) -> Column:
        return (F.size(a[field]) > 0) & (F.size(b[field]) > 0)

    def graph(field: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col("g")[field], F.lit(default)) if summaries is not None else F.lit(default)

    peers = F.coalesce("peers", F.lit(0.0)) if support is not None else F.lit(0.0)
    postal_conflict = both("postals") & ~postal
    houses = (a["house_number"] != "") & (b["house_number"] != "")
    suffix_conflict = base & (a["house_suffix"] != "") & (b["house_suffix"] != "") & (a["house_suffix"] != b["house_suffix"])
    same_state = S.same_set(a["state_words"], b["state_words"])
    state_conflict = both("state_words") & ~same_state
    layouts = F.filter(F.array(a["layout_share"], b["layout_share"]), lambda v: v.isNotNull())
    values = {
        "name_exact": _flag((a["name_raw"] != "") & (a["name_raw"] == b["name_raw"])), "name_core_exact": _flag((a["name_core"] != "") & (a["name_core"] == b["name_core"])),
        "name_token_jaccard": nj, "name_token_containment": S.containment(a["name_words"], b["name_words"]),
        "name_char_similarity": e["name_char"], "name_jaro_winkler": e["name_jaro"], "name_char_ngram_jaccard": grams["name_jaccard"], "name_char_ngram_cosine": grams["name_cosine"],
        "name_tfidf_cosine": _best(a["variant_tfidf"], b["variant_tfidf"], S.cosine), "name_sorted_token_similarity": e["name_sorted"], "name_token_order_similarity": e["name_order"],
        "candidate_retrieval_rank_reciprocal": F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(F.lit(0.0)),
        "candidate_retrieval_score": 9.0 * _flag(postal) + 4.0 * _flag(base) + 3.0 * aj + 2.0 * cj + nj - 4.0 * _flag(differs),
        "name_prefix_similarity": S.prefix_share(a["name_core"], b["name_core"]), "name_suffix_similarity": e["name_char"], "name_variant_similarity": e["name_variant"],
        "name_length_ratio": S.ratio(F.length(a["name_core"]), F.length(b["name_core"])), "common_name_tokens": S.common(a["name_words"], b["name_words"]),
        "name_rare_token_overlap": S.weighted_overlap(a["name_idf"], b["name_idf"]), "address_exact": _flag((a["address_raw"] != "") & (a["address_raw"] == b["address_raw"])),
        "address_token_jaccard": aj, "address_token_containment": S.containment(a["address_words"], b["address_words"]), "address_char_similarity": e["address_char"],
        "address_char_ngram_jaccard": grams["address_jaccard"], "address_char_ngram_cosine": grams["address_cosine"],
        "address_tfidf_cosine": S.cosine(a["address_tfidf"], b["address_tfidf"]), "address_length_ratio": S.ratio(F.size(a["address_words"]), F.size(b["address_words"])),
        "common_address_tokens": S.common(a["address_words"], b["address_words"]), "address_rare_token_overlap": S.weighted_overlap(a["address_idf"], b["address_idf"]),
        "address_landmark_overlap": S.jaccard(a["landmarks"], b["landmarks"]), "number_token_jaccard": S.jaccard(a["numbers"], b["numbers"]),
        "house_number_match": _flag(houses & (a["house_number"] == b["house_number"])), "house_number_base_match": _flag(base),
        "house_number_suffix_conflict": _flag(suffix_conflict), "house_number_conflict": _flag(houses & ~base),
        "unit_number_match": _flag(S.overlap(a["units"], b["units"])), "unit_number_conflict": _flag(both("units") & ~S.overlap(a["units"], b["units"])),
        "postal_code_match": _flag(postal), "postal_code_conflict": _flag(postal_conflict), "city_token_jaccard": cj, "city_exact": _flag(S.same_set(a["city_words"], b["city_words"])),
        "state_match": _flag(same_state), "state_conflict": _flag(state_conflict),
        "tail_component_similarity": S.jaccard(*(F.slice(x["city_words"], F.greatest(F.size(x["city_words"]) - 3, F.lit(1)), 4) for x in (a, b))),
        "same_country": _flag(known & ~differs), "country_conflict": _flag(differs), "name_address_consistency": nj * aj, "city_name_consistency": nj * cj,
        "name_postal_consistency": nj * _flag(postal), "phone_fragment_match": _flag(S.overlap(a["phones"], b["phones"])),
        "cross_source_cluster_size": graph("cluster_size", 1.0), "cross_source_support_count": graph("support_count"), "s2_s3_name_similarity": graph("name_similarity"),
        "s2_s3_address_similarity": graph("address_similarity"), "s2_s3_cluster_agreement": graph("cluster_agreement"),
        "cross_source_candidate_support_count": peers, "cross_source_candidate_agreement": _flag(peers > 0), "cross_source_direct_edge_count": graph("direct_edge_count"),
        "cross_source_max_edge_score": graph("max_edge_score"), "cross_source_min_edge_score": graph("min_edge_score"), "cross_source_avg_edge_score": graph("avg_edge_score"),
        "candidate_source_s2": _flag(F.col("candidate_id").startswith("S2-")), "candidate_source_s3": _flag(F.col("candidate_id").startswith("S3-")),
        "candidate_retrieval_channel_count": F.size("channels").cast("double"), "candidate_block_name_phonetic": _flag(F.array_contains("channels", "name_phonetic")),
        "candidate_block_name_tfidf": _flag(F.array_contains("channels", "name_tfidf")),
        "contradiction_score": 5.0 * _flag(differs) + 4.0 * _flag(postal_conflict) + 2.0 * _flag(houses & ~base) + 1.5 * _flag(suffix_conflict) + 2.0 * _flag(state_conflict),
        "address_layout_country_plausibility": _mean(layouts), "address_layout_pattern_match": _flag(known & ~differs & (a["layout"] == b["layout"])),
        "postal_country_pattern_support": _mean(F.concat(a["postal_shares"], b["postal_shares"])), "has_name_both": _flag(both("name_words")), "has_address_both": _flag(both("address_words")),
    }
    blocks = {f"candidate_block_{c}": _flag(F.array_contains("channels", c)) for c in CHANNELS if f"candidate_block_{c}" not in PAIR_FEATURES}
    values |= blocks | {"rank": F.col("rank")}
    wanted = only or (*PAIR_FEATURES, *blocks)
    return pairs.select("query_id", "candidate_id", *carried, *[(values[c] if c == "rank" else values[c].cast("double")).alias(c) for c in wanted])
