"""Parsing of addresses, as column expressions.

An address is cut into components at commas, semicolons and line ends; a component is an
array of words. Components that only name the country are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.constants import ADDRESS_WORDS, COUNTRY_ALIASES, COUNTRY_COMPONENTS, INDIAN_CODES, INDIAN_STATES, LANDMARK_WORDS, STOP_WORDS, UNIT_WORDS, US_STATES
from affinis.functions.text import DEFAULT, Normalisation, literal_map, mapped, normalise, split_words, tokens

POSTAL = r"^\d{5,6}$"
NUMBER = r"^\d+[a-z]?$"


def _no_words() -> Column:
    return F.array().cast("array<string>")


def address_words(text: Column, how: Normalisation = DEFAULT) -> Column:
    words = tokens(text)
    return mapped(words, ADDRESS_WORDS) if how.expand_addresses else words


def split_parts(address: Column, how: Normalisation = DEFAULT) -> Column:
    """array<array<string>>: the words of every component."""
    return F.transform(F.split(F.coalesce(address, F.lit("")), r"[,;\n]+"), lambda p: address_words(p, how))


def without_country(parts: Column, country: Column) -> Column:
    """Components that have words and don't just name the country; ``country`` is normalised, or ''."""
    aliases = literal_map(COUNTRY_ALIASES)

    def is_place(words: Column) -> Column:
        text = F.array_join(words, " ")
        own = (country != "") & (F.coalesce(aliases[text], text) == country)
        return (F.size(words) > 0) & ~own & ~text.isin(*COUNTRY_COMPONENTS)

    return F.filter(parts, is_place)


def components(address: Column, country: Column, how: Normalisation = DEFAULT) -> Column:
    return without_country(split_parts(address, how), country)


def _state_of(words: Column, country: Column) -> Column:
    """struct<state, at> for the state that ends the words (postal codes aside), else null;
    ``at`` is the number of words before it. Names of states are looked up in one map per
    country, from the longest phrase to the shortest; a code is a phrase of one word."""
    us = literal_map({**{n: n for n in US_STATES.values()}, **US_STATES})
    india = literal_map({**{n: n for n in INDIAN_STATES}, **INDIAN_CODES})
    plain = F.filter(words, lambda w: ~w.rlike(POSTAL))
    name = F.when(country == "us", us).when(country == "india", india)

    def phrase(k: int) -> Column:
        return F.array_join(F.slice(plain, -k, k), " ")

    tries = F.transform(F.array(*[F.struct(F.lit(k).alias("k"), phrase(k).alias("text")) for k in (4, 3, 2, 1)]), lambda t: F.struct(t["k"], F.element_at(name, t["text"]).alias("state")))
    hit = F.get(F.filter(tries, lambda t: t["state"].isNotNull() & (t["k"] <= F.size(plain))), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["state"].alias("state"), (F.size(plain) - hit["k"]).alias("at")))


def _no_numbers(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike(NUMBER))


def _locality(words: Column) -> Column:
    """Words without numbers; a leading ``street`` is a saint here."""
    plain = _no_numbers(words)
    return F.transform(plain, lambda w, i: F.when((i == 0) & (w == "street"), F.lit("saint")).otherwise(w))


def states(parts: Column, country: Column) -> Column:
    """Per component its state (struct or null)."""
    return F.transform(parts, lambda c: _state_of(c, country))


def with_city(rows: DataFrame, parts: str, found: str, country: str, name: str = "city_words") -> DataFrame:
    """Adds the words of the locality. ``found`` is states(parts, country).

    In the US and India the state's component, or else the one before it, names the city; elsewhere,
    and where no state is found, what follows the postal code does, or the component before."""
    none, p = _no_words(), F.col(parts)

    def before(i: Column) -> Column:
        return F.when(i > 0, F.get(p, i - 1)).otherwise(none)

    step = rows.withColumn("_n", F.size(p)).withColumn("_has", F.transform(p, lambda c: F.exists(c, lambda w: w.rlike(POSTAL))))
    last, second = F.col("_n") - 1, F.col("_n") - 2
    at_state = F.when(F.get(found, F.greatest(last, F.lit(0))).isNotNull(), last).when((second >= 0) & F.get(found, F.greatest(second, F.lit(0))).isNotNull(), second)
    at_postal = F.col("_n") - F.array_position(F.reverse("_has"), True).cast("int")  # n: none has one
    step = step.withColumns({"_s": F.when(F.col(country).isin("us", "india"), at_state), "_p": at_postal})
    step = step.withColumns({"_state": F.get(found, F.coalesce("_s", F.lit(0))), "_plain": _no_numbers(F.get(p, F.coalesce("_s", F.lit(0)))), "_c": F.get(p, "_p")})
    place = F.size("_c") - F.array_position(F.reverse(F.transform("_c", lambda w: w.rlike(POSTAL))), True) + 1  # of the last code, from 1
    step = step.withColumn("_front", F.slice("_plain", F.lit(1), F.greatest(F.least(F.col("_state.at"), F.size("_plain")), F.lit(0))))
    step = step.withColumn("_behind", _no_numbers(F.slice("_c", (place + 1).cast("int"), F.size("_c") + 1)))
    by_state = F.when(F.size("_front") > 0, F.col("_front")).otherwise(before(F.col("_s")))
    by_postal = F.when(F.size("_behind") > 0, F.col("_behind")).otherwise(before(F.col("_p")))
    last_one = F.when(F.col("_n") >= 2, F.get(p, F.greatest(last, F.lit(0)))).otherwise(none)
    chosen = F.when(F.col("_n") == 0, none).when(F.col("_s").isNotNull(), by_state).when(F.col("_p") < F.col("_n"), by_postal).otherwise(last_one)
    step = step.withColumn("_chosen", F.coalesce(chosen, none)).withColumn(name, _locality(F.col("_chosen")))
    return step.drop("_n", "_has", "_s", "_p", "_state", "_plain", "_c", "_front", "_behind", "_chosen")


def state_words(found: Column, country: Column) -> Column:
    """Distinct words of the state in the last three components, the last first."""
    tail = F.filter(F.reverse(F.slice(found, F.greatest(F.size(found) - 2, F.lit(1)), 3)), lambda s: s.isNotNull())
    state = F.get(tail, F.lit(0))["state"]
    return F.when(country.isin("us", "india") & state.isNotNull(), F.array_distinct(F.split(state, " "))).otherwise(_no_words())


def numbers(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: w.rlike(NUMBER)))


def postal_codes(address: Column) -> Column:
    """Distinct runs of five or six digits; a long house number is one too."""
    return postals_of(normalise(address))


def postals_of(normal: Column) -> Column:
    runs = F.regexp_extract_all(normal, F.lit(r"\d+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda d: F.length(d).between(5, 6)))


def house_number(address: Column) -> Column:
    """The first number of the first comma component. ``348th`` gives 34, as the pattern backs off a digit."""
    first = normalise(F.substring_index(F.coalesce(address, F.lit("")), ",", 1))
    return F.regexp_extract(first, r"(?<![a-z])\d+[a-z]?(?![a-z])", 0)


def house_base(house: Column) -> Column:
    return F.regexp_extract(house, r"^(\d+)([a-z]?)$", 1)


def house_suffix(house: Column) -> Column:
    return F.regexp_extract(house, r"^(\d+)([a-z]?)$", 2)


def unit_numbers(words: Column) -> Column:
    """Numbers right after a unit word, or after ``number`` or ``no`` behind it."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))

    def unit(i: Column) -> Column:
        after = F.get(words, i + 1)
        value = F.when(after.isin("number", "no"), F.get(words, i + 2)).otherwise(after)
        return F.when(F.get(words, i).isin(*UNIT_WORDS) & value.rlike(NUMBER), value)

    return F.array_distinct(F.filter(F.transform(places, unit), lambda u: u.isNotNull()))


def landmark_words(parts: Column) -> Column:
    """Up to four words after a landmark word in its component, up to the first number, without stop words."""

    def after(words: Column, i: Column) -> Column:
        tail = F.slice(words, i + 2, 4)
        stop = F.array_position(F.transform(tail, lambda w: w.rlike(NUMBER)), True)
        kept = F.when(stop > 0, F.slice(tail, 1, stop.cast("int") - 1)).otherwise(tail)
        return F.when(F.get(words, i).isin(*LANDMARK_WORDS), kept).otherwise(_no_words())

    found = F.flatten(F.flatten(F.transform(parts, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: after(c, i)))))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def phone_fragments(address: Column) -> Column:
    """Digits of phone-like runs, 8 to 15 of them."""
    runs = F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(r"\+?\d[\d\s()./-]{6,}\d"), F.lit(0))
    digits = F.transform(runs, lambda r: F.regexp_replace(r, r"\D", ""))
    return F.array_distinct(F.filter(digits, lambda d: F.length(d).between(8, 15)))


def with_layout(rows: DataFrame, parts: str, name: str = "layout") -> DataFrame:
    """Adds the shape of an address: how many components, and where postal code and numbers stand."""
    p, n = F.col(parts), F.size(parts)
    step = rows.withColumns(
        {
            "_postal_at": F.array_position(F.transform(p, lambda c: F.array_join(c, " ").rlike(r"(?<!\d)\d{5,6}(?!\d)")), True),
            "_number_at": F.array_position(F.transform(p, lambda c: F.exists(c, lambda w: w.rlike(NUMBER))), True),
            "_first": F.coalesce(F.get(p, F.lit(0)), _no_words()),
        }
    )
    step = step.withColumn("_c", F.get(p, (F.col("_postal_at") - 1).cast("int")))
    step = step.withColumns({"_at": F.array_position(F.transform("_c", lambda w: w.rlike(POSTAL)), True).cast("int"), "_starts": F.coalesce(F.get("_first", F.lit(0)).rlike(NUMBER), F.lit(False))})
    # a code within a longer word (_at = 0) leaves all but the last word before it, and every word after it
    before = F.slice("_c", F.lit(1), F.greatest(F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.size("_c")) - 1, F.lit(0)))
    after = F.slice("_c", F.col("_at") + 1, F.size("_c") + 1)
    step = step.withColumns({"_before": F.exists(before, lambda w: w.rlike("[a-z]")), "_after": F.exists(after, lambda w: w.rlike("[a-z]"))})
    order = F.when(F.col("_c").isNull(), "none").when(F.col("_before") & ~F.col("_after"), "text_before").when(F.col("_after") & ~F.col("_before"), "text_after").otherwise("mixed")
    postal = F.when(F.col("_postal_at") == 0, "none").when(F.col("_postal_at") == n, "last").when(F.col("_postal_at") == 1, "first").otherwise("middle")
    number = F.when(F.col("_number_at") == 0, "none").when(F.col("_number_at") == 1, "first").when(F.col("_number_at") == n, "last").otherwise("middle")
    shape = F.when(F.col("_starts"), "number_first").when(F.exists("_first", lambda w: w.rlike(NUMBER)), "number_later").when(F.size("_first") > 0, "text").otherwise("empty")
    starts = F.col("_starts").cast("int").cast("string")
    count = F.least(n, F.lit(4)).cast("string")
    text = F.concat(F.lit("c"), count, F.lit("|p"), postal, F.lit("|o"), order, F.lit("|n"), starts, F.lit("|h"), number, F.lit("|f"), shape)
    return step.withColumn(name, text).drop("_postal_at", "_number_at", "_first", "_c", "_at", "_starts", "_before", "_after")


def words_of(normal: Column, how: Normalisation = DEFAULT) -> Column:
    """address_words of a text that is normalised already."""
    words = split_words(normal)
    return mapped(words, ADDRESS_WORDS) if how.expand_addresses else words
