"""Normalisation of names, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.constants import ALIAS_MARKERS, COUNTRY_ALIASES, LEGAL_SUFFIXES, NAME_WORDS

#: Letters that decompose into more than one letter.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ﬁ": "fi", "ﬂ": "fl"}


@dataclass(frozen=True)
class Normalisation:
    """Which steps are taken; an ablation turns one off."""

    strip_suffixes: bool = True
    split_aliases: bool = True
    expand_addresses: bool = True


DEFAULT = Normalisation()


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their bases, by Unicode decomposition."""
    pairs = {}
    for code in (*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if len(letter) == len(base) == 1 and letter != base and base.isascii():
            pairs[letter] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()

#: Letters of other scripts and the Latin letter of each. Hard and soft signs have none.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшыэюяіїєґўјљњћђџ", "abvgdeozziiklmnoprstufktcsyeuaiieguj" + "lncdd", strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "abgdezetiklmnxoprsstupkpo", strict=True))
#: Letters that take another Latin letter after or before their own, and one that stands for two.
FOLLOWED = {"h": "жхчшθφχ", "s": "цψ"}
PRECEDED = {"i": "ёюяє", "a": ""}
SIGNS = "ъь"
#: First code of Devanagari, and the distance and number of the blocks of Indian scripts that are laid out like it.
DEVANAGARI, BLOCK, BLOCKS = 0x0900, 0x80, 9


def _indian() -> tuple[dict[str, str], str, str]:
    """Latin letters of Indian letters, those aspirated, and those of two vowels, by their names in Devanagari.

    A consonant stands for its first letter, its own vowel is not written; a vowel stands for its last letter."""
    letters, aspirated, double = {}, "", ""
    for at in range(BLOCK):
        code = chr(DEVANAGARI + at)
        found = re.fullmatch(r"DEVANAGARI (LETTER|VOWEL SIGN|DIGIT|SIGN) (?:.* )?(\w+)", unicodedata.name(code, ""))
        if not found:
            continue
        kind, sound = found.groups()
        every = "".join(chr(ord(code) + BLOCK * i) for i in range(BLOCKS))
        if kind == "DIGIT":
            letter = str(unicodedata.digit(code))
        elif kind == "SIGN":
            letter = "n" if sound in ("ANUSVARA", "CANDRABINDU") else ""
        elif kind == "LETTER" and sound[0] not in "AEIOU" and sound.endswith("A"):
            letter = sound[0].lower()
            aspirated += every if "H" in sound[1:] else ""
        else:
            letter = sound[-1].lower()
            double += every if sound in ("AI", "AU") else ""
        if letter:
            letters |= dict.fromkeys(every, letter)
    return letters, aspirated, double


def _accented(table: dict[str, str], first: int, last: int) -> dict[str, str]:
    """The letters of a range that decompose to one of the table and marks."""
    bases = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(first, last)}
    return {c: table[b] for c, b in bases.items() if b in table and c not in table}


_INDIAN, _ASPIRATED, _DOUBLE = _indian()
LETTERS = CYRILLIC | _accented(CYRILLIC, 0x0400, 0x0530) | GREEK | _accented(GREEK, 0x0370, 0x03D0) | _INDIAN
FOLLOWED["h"] += _ASPIRATED
PRECEDED["a"] += _DOUBLE
OTHER_SCRIPTS = f"[\u0370-\u052f{chr(DEVANAGARI)}-{chr(DEVANAGARI + BLOCK * BLOCKS - 1)}]"


def transliterate(low: Column) -> Column:
    """Lower-case Cyrillic, Greek and Indian letters in Latin ones; all else stays as it is."""
    out = F.replace(low, F.lit("щ"), F.lit("шч"))
    for latin, letters in FOLLOWED.items():
        out = F.regexp_replace(out, f"([{letters}])", f"$1{latin}")
    for latin, letters in PRECEDED.items():
        out = F.regexp_replace(out, f"([{letters}])", f"{latin}$1")
    # characters of the first string that the second has no partner for are deleted
    out = F.translate(out, "".join(LETTERS) + SIGNS, "".join(LETTERS.values()))
    return F.when(low.rlike(OTHER_SCRIPTS), out).otherwise(low)


def normalise(text: Column) -> Column:
    """Lower case without accents, other alphabets in Latin letters; runs of anything but a-z and 0-9 become one space. Null gives ''."""
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    low = F.replace(F.replace(low, F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" "))
    folded = F.translate(F.regexp_replace(transliterate(low), r"\p{M}+", ""), FOLD_FROM, FOLD_TO)
    spelled = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLED.items(), folded)
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def mapped(words: Column, entries: dict[str, str]) -> Column:
    """The words, each replaced if the map has it."""
    table = literal_map(entries)
    return F.transform(words, lambda w: F.coalesce(table[w], w))


def split_words(normal: Column) -> Column:
    """Words of a normalised text; none for ''."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    return split_words(normalise(text))


def normalise_country(country: Column) -> Column:
    normal = normalise(country)
    return F.coalesce(literal_map(COUNTRY_ALIASES)[normal], normal)


_SUFFIXES = "|".join(LEGAL_SUFFIXES)


def strip_suffixes(name: Column) -> Column:
    """A normalised name without the legal forms at its end; may become ''."""
    return F.regexp_replace(name, f"(?:(?:^| )(?:{_SUFFIXES}))+$", "")


def name_variants(text: Column, how: Normalisation = DEFAULT) -> Column:
    """Array of one or two normalised names: the name proper and its alias; empty for an empty name."""
    return _variants(F.array_join(mapped(tokens(text), NAME_WORDS), " "), how)


def with_variants(rows: DataFrame, normal: str, name: str, how: Normalisation = DEFAULT) -> DataFrame:
    """Adds the variants of a normalised name."""
    step = rows.withColumn("_name", F.array_join(mapped(split_words(F.col(normal)), NAME_WORDS), " "))
    return step.withColumn(name, _variants(F.col("_name"), how)).drop("_name")


def _variants(name: Column, how: Normalisation) -> Column:
    core = strip_suffixes if how.strip_suffixes else (lambda c: c)
    whole = F.filter(F.array(core(name)), lambda v: v != "")
    if not how.split_aliases:
        return whole
    marker = rf"(?:^| )(?:{'|'.join(ALIAS_MARKERS)})(?: |$)"
    parts = F.filter(F.transform(F.split(name, marker, 2), lambda v: core(F.trim(v))), lambda v: v != "")
    return F.when(name.rlike(marker) & (F.size(parts) > 0), parts).otherwise(whole)


def core_name(text: Column, how: Normalisation = DEFAULT) -> Column:
    return F.coalesce(F.get(name_variants(text, how), F.lit(0)), F.lit(""))


def soundex(text: Column) -> Column:
    letters = F.regexp_replace(normalise(text), "[^a-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def name_ngrams(variants: Column, most: int) -> Column:
    """Distinct character trigrams of the names without spaces (a shorter name is its own), ``most``
    of them at even distances if there are more; all for most <= 0."""
    joined = F.transform(variants, lambda v: F.replace(v, F.lit(" "), F.lit("")))
    every = F.flatten(F.transform(joined, lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(v) - 2)), lambda i: F.substr(v, i, F.lit(3)))))
    if most <= 0:
        return F.array_distinct(every)
    last = F.size(every) - 1
    steps = F.sequence(F.lit(0), F.lit(most - 1))
    even = F.transform(steps, lambda i: F.get(every, F.floor(i * last / max(1, most - 1)).cast("int")))
    return F.array_distinct(F.when(F.size(every) <= most, every).otherwise(even))


def char_ngrams(text: Column, size: int = 3) -> Column:
    """Distinct character n-grams of a text without spaces; a shorter text is its own, '' has none."""
    joined = F.replace(text, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(joined) - size + 1)), lambda i: F.substr(joined, i, F.lit(size)))
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))
