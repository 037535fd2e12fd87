"""One row of parsed fields per record, computed once and joined to pairs afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions import address as A
from affinis.functions import text as T


def profile(records: DataFrame, how: T.Normalisation = T.DEFAULT) -> DataFrame:
    """entity_id, business_name, business_address, country -> the parsed record.

    Built in steps, so that what several fields need is computed once."""
    text = records.select(
        "entity_id", F.col("business_name").alias("name_text"), F.coalesce("business_address", F.lit("")).alias("address_text"),
        T.normalise(F.col("business_name")).alias("name_raw"), T.normalise(F.col("business_address")).alias("address_raw"), T.normalise_country(F.col("country")).alias("country"),
    )
    names = T.with_variants(text, "name_raw", "variants", how).withColumn("name_core", F.coalesce(F.get("variants", F.lit(0)), F.lit("")))
    words = names.withColumns({"name_words": T.split_words(F.col("name_core")), "address_words": A.words_of(F.col("address_raw"), how), "every": A.split_parts(F.col("address_text"), how)})
    parts = words.withColumns({"parts": A.without_country(F.col("every"), F.col("country")), "all_parts": A.without_country(F.col("every"), F.lit("")), "house_number": A.house_number(F.col("address_text"))})
    stated = parts.withColumn("found_states", A.states(F.col("parts"), F.col("country")))
    placed = A.with_layout(A.with_city(stated, "parts", "found_states", "country"), "parts")
    return placed.select(
        "entity_id", "name_text", "name_raw", "variants", "name_core", "name_words", "address_raw", "address_words", "country", "city_words",
        A.state_words(F.col("found_states"), F.col("country")).alias("state_words"), A.numbers(F.col("address_words")).alias("numbers"),
        A.unit_numbers(F.col("address_words")).alias("units"), A.phone_fragments(F.col("address_text")).alias("phones"), A.postals_of(F.col("address_raw")).alias("postals"),
        "layout", "house_number", A.house_base(F.col("house_number")).alias("house_base"), A.house_suffix(F.col("house_number")).alias("house_suffix"),
        A.landmark_words(F.col("all_parts")).alias("landmarks"),
    )
