"""Similarities of words, sets and strings. What is empty on either side has similarity 0."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _guarded(value: Column, a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), value).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return _guarded(common(a, b) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), a, b)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return _guarded(common(a, b) / F.greatest(least, F.lit(1)), a, b)


def set_cosine(a: Column, b: Column) -> Column:
    """Of arrays of distinct items."""
    return _guarded(common(a, b) / F.sqrt(F.greatest(F.size(a) * F.size(b), F.lit(1))), a, b)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) > 0


def ratio(a: Column, b: Column) -> Column:
    """The smaller of two sizes over the larger; 0 if one is 0."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(0.0))


def prefix_share(a: Column, b: Column) -> Column:
    """Length of the common prefix over the shorter length."""
    least = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    same = F.coalesce(F.get(differs, F.lit(0)) - 1, least)
    return F.when(least > 0, same / least).otherwise(F.lit(0.0))


def idf(df: Column, n: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + F.coalesce(df, F.lit(0)))) + 1.0


def weighted_overlap(a: Column, b: Column) -> Column:
    """Of maps from item to weight: the weight of the common items over that of all."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda s, k: s + F.coalesce(a[k], b[k]))

    return F.when((F.size(a) > 0) & (F.size(b) > 0), total(both) / total(keys)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Of maps from item to weight."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    dot = F.aggregate(both, F.lit(0.0), lambda s, k: s + a[k] * b[k])

    def norm(m: Column) -> Column:
        return F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))

    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of lengths, by bit-parallel search."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return 2 * (len(a) - state.bit_count()) / (len(a) + len(b))


#: Places of the table of character masks of pairs that are compared at once.
MASKS = 1 << 20


def indel_ratios(a: list[str], b: list[str]) -> list[float]:
    """indel_ratio of each pair: the same search, a character of all pairs at a time, if one text has no more than 64."""
    out = np.zeros(len(a))
    short, long = [min(x, y, key=len) for x, y in zip(a, b, strict=True)], [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    m, n = (np.array([len(x) for x in side], np.int64) for side in (short, long))
    for i in np.flatnonzero(m > 64).tolist():
        out[i] = indel_ratio(short[i], long[i])
    some = np.flatnonzero((m > 0) & (m <= 64))
    points = [np.frombuffer("".join([side[i] for i in some.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32) for side in (short, long)]
    known = np.zeros(max((int(x.max(initial=0)) for x in points), default=0) + 1, np.int64)
    for x in points:
        known[x] = 1
    number, kinds = np.cumsum(known) - 1, int(known.sum())
    codes, starts = [number[x] for x in points], [np.cumsum(size[some]) - size[some] for size in (m, n)]
    at_once = max(1, MASKS // max(kinds, 1))
    for begin in range(0, len(some), at_once):
        mine = slice(begin, begin + at_once)
        sizes, (first, second) = (m[some[mine]], n[some[mine]]), (x[mine] for x in starts)
        masks = np.zeros((len(first), kinds), np.uint64)
        for i in range(int(sizes[0].max())):
            at = np.flatnonzero(sizes[0] > i)
            masks[at, codes[0][first[at] + i]] |= np.uint64(1 << i)
        full = np.uint64(2**64 - 1) >> (64 - sizes[0]).astype(np.uint64)
        state = full.copy()
        for j in range(int(sizes[1].max())):
            at = np.flatnonzero(sizes[1] > j)
            s = state[at]
            hit = s & masks[at, codes[1][second[at] + j]]
            state[at] = ((s + hit) | (s - hit)) & full[at]
        out[some[mine]] = 2 * (sizes[0] - np.bitwise_count(state)) / (sizes[0] + sizes[1])
    return out.tolist()


@lru_cache(maxsize=1_000)
def _grams(text: str, size: int = 3) -> set[str]:
    """What ``char_ngrams`` gives; pairs of a candidate follow each other."""
    joined = text.replace(" ", "")
    return {joined[i : i + size] for i in range(max(1, len(joined) - size + 1))} if joined else set()


def gram_similarities(a: str, b: str) -> tuple[float, float]:
    """Jaccard similarity and cosine of the distinct n-grams of two texts."""
    x, y = _grams(a), _grams(b)
    both = len(x & y)
    return (both / (len(x) + len(y) - both), both / sqrt(len(x) * len(y))) if x and y else (0.0, 0.0)


def jaro_winkler(a: str, b: str, weight: float = 0.1, above: float = 0.7) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro) if jaro > above else jaro


def order_similarity(a: list[str], b: list[str]) -> float:
    """Ratcliff-Obershelp similarity of word sequences."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


EDITS = "name_char double, name_jaro double, name_sorted double, name_order double, name_variant double, name_gram_jaccard double, name_gram_cosine double, address_gram_jaccard double, address_gram_cosine double, address_char double"


def edit_similarities(variants_a: Column, variants_b: Column, address_a: Column, address_b: Column) -> Column:
    """All similarities of a pair that no built-in expresses, as a struct: one pass over Arrow
    batches of the two arrays of name variants and the two normalised addresses."""
    return F.arrow_udf(_edits, EDITS)(variants_a, variants_b, address_a, address_b)


@lru_cache(maxsize=100_000)
def _name_edits(va: tuple[str, ...], vb: tuple[str, ...]) -> tuple[float, ...]:
    """Of two records' name variants; the same names meet in many pairs."""
    a, b = va[0] if va else "", vb[0] if vb else ""
    wa, wb = a.split(), b.split()
    best = 0.0
    for x in va:
        for y in vb:
            sx, sy = set(x.split()), set(y.split())
            best = max(best, len(sx & sy) / len(sx | sy), indel_ratio(x, y))
    return indel_ratio(a, b), jaro_winkler(a, b), indel_ratio(" ".join(sorted(wa)), " ".join(sorted(wb))), order_similarity(wa, wb), best, *gram_similarities(a, b)


def _edits(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        va, vb, aa, ab = (c.to_pylist() for c in columns)
        aa, ab = ([x or "" for x in side] for side in (aa, ab))
        out = [(*_name_edits(tuple(x or ()), tuple(y or ())), *gram_similarities(i, j)) for x, y, i, j in zip(va, vb, aa, ab, strict=True)]
        names = [f.split()[0] for f in EDITS.split(", ")]
        yield pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in (*(zip(*out, strict=True) if out else [()] * (len(names) - 1)), indel_ratios(aa, ab))], names)
