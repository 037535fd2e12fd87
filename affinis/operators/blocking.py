"""Blocking: keys per channel, their frequencies, and the postings that survive the ceiling.

A key is (channel, scope, value); the scope is the record's country and, once more, ``*``.
A record has each key once. Frequencies are counted before keys over the ceiling are
dropped, and that is done before records meet over keys, so that no key is both frequent
and joined.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions import text as T
from affinis.functions.constants import CHANNELS, STOP_WORDS

KEY = ["channel", "scope", "value"]
FALLBACK_CHANNELS = ("name_phonetic",)


@dataclass(frozen=True)
class Blocking:
    """max_frequency: postings a key may have, times its channel's multiple; 0: any."""

    max_frequency: int = 10_000
    limit_multiplier: float = 1.0
    ngrams: int = 6
    context: str = "once"

    def settings(self) -> dict:
        return asdict(self)


DEFAULT = Blocking()


def channels(spark: SparkSession, how: Blocking = DEFAULT) -> DataFrame:
    """The ten channels: weight, limit (at least 1) and ceiling (null: none)."""
    rows = [
        (name, weight, max(1, int(-(-(limit * how.limit_multiplier) // 1))), how.max_frequency * multiple if how.max_frequency > 0 else None)
        for name, (weight, limit, multiple) in CHANNELS.items()
    ]
    return spark.createDataFrame(rows, "channel string, weight double, top int, ceiling long")


def _worth(words: Column, least: int) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def keys(profiles: DataFrame, how: Blocking = DEFAULT) -> DataFrame:
    """entity_id, channel, scope, value: each key of each record once."""
    strings = "array<string>"
    name_words = F.transform("variants", lambda v: _worth(F.split(v, " "), 3))
    pairs = F.flatten(
        F.transform(name_words, lambda ws: F.filter(F.transform(ws, lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1))), lambda p: p.contains(" ")))
    )
    singles = F.flatten(name_words)
    house = F.filter(F.array("house_number"), lambda h: h != "")
    values = {
        "name_exact": F.filter("variants", lambda v: F.length(v) >= 4), "name_token": singles, "name_pair": pairs,
        "name_phonetic": F.filter(F.transform(singles, _soundex), lambda c: c != ""), "name_char_ngram": T.name_ngrams(F.col("variants"), how.ngrams),
        "address_token": _worth(F.col("address_words"), 4), "postal": F.col("postals"), "house_number": house, "city_token": _worth(F.col("city_words"), 3),
    }
    per_channel = F.array(*[F.struct(F.lit(c).alias("channel"), F.array_distinct(v.cast(strings)).alias("values")) for c, v in values.items()])
    exploded = profiles.select("entity_id", "country", F.explode(per_channel).alias("k")).select("entity_id", "country", "k.channel", F.explode("k.values").alias("value"))
    scopes = F.explode(F.array_distinct(F.array(F.col("country"), F.lit("*")))).alias("scope")
    return exploded.select("entity_id", "channel", scopes, "value")


def _soundex(word: Column) -> Column:
    letters = F.regexp_replace(word, "[^a-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def key_frequencies(target_keys: DataFrame) -> DataFrame:
    return target_keys.groupBy(*KEY).agg(F.count("*").alias("df"))


def postings(target_keys: DataFrame, frequencies: DataFrame, how: Blocking = DEFAULT) -> DataFrame:
    """channel, scope, value, candidate_id, df for the keys within their channel's ceiling."""
    within = frequencies.join(F.broadcast(channels(frequencies.sparkSession, how).select("channel", "ceiling")), "channel")
    within = within.filter("ceiling is null or df <= ceiling").drop("ceiling")
    return target_keys.withColumnRenamed("entity_id", "candidate_id").join(within, KEY)


def name_frequencies(profiles: DataFrame) -> DataFrame:
    """Documents per name word, over all variants of a name."""
    words = F.explode(F.array_distinct(F.flatten(F.transform("variants", lambda v: F.split(v, " "))))).alias("word")
    return profiles.select(words).groupBy("word").agg(F.count("*").alias("df"))


def address_frequencies(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.explode(F.array_distinct("address_words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def layout_counts(profiles: DataFrame) -> DataFrame:
    return profiles.filter("country <> ''").groupBy("country", "layout").agg(F.count("*").alias("n"))


def postal_length_counts(profiles: DataFrame) -> DataFrame:
    """Per postal code, not per record."""
    lengths = profiles.filter("country <> ''").select("country", F.explode("postals").alias("code"))
    return lengths.groupBy("country", F.length("code").alias("digits")).agg(F.count("*").alias("n"))
