"""Benchmark decontamination with a distributed positional inverted index.

The index is built once, over all words of the training documents, and is partitioned by
documents: each task writes segments of about ``SEGMENT_WORDS`` words. A segment stores its
distinct terms, sorted, with the sorted positions of each (the term's postings), and the
directory of its documents. Documents in a segment are numbered by its id and their place.

The benchmark is the query set. It is probed in blocks of ``ITEM_BLOCK`` items, which bounds what
is sent to the tasks; every block reads the one stored index. Corpus frequencies of a block's
terms are summed over all segments. A phrase is then looked up segment by segment: the postings
of its rarest term, less that term's offset in the phrase, are candidate starts, which are
intersected with the offset-adjusted postings of its other terms from rare to frequent until none
is left. Postings never leave their segment, so no term, however frequent, lands in one task. Only
documents with a match come out of a block, and their matches are joined to the directory.

A phrase is a window of ``WINDOW`` consecutive words of an item, or the whole item if it
has fewer. With ``slop`` above 0 proximity matches are returned too: the phrase's words in
order within slop extra words. One index serves any slop.

Defined cases: a null or wordless text has no words; a null or wordless item matches
nothing. An item without an id is left out, or with ``unnamed``, as in the query and the
pipeline, its passages count as hits and it is left out of the list of ids only. Items that
share an id are one. A text of any length is indexed whole, as one document of one segment. Repeated documents
and documents without an id are all returned. An empty benchmark finds nothing. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm._shared import keep_rows, small_batches, staged, text_key

WINDOW = 10
SEGMENT_WORDS = 1_000_000
ITEM_BLOCK = 20_000
#: Words are runs of letters and digits, and of all beyond ASCII, after lower-casing A-Z: all other bytes become blanks.
LETTERS = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(LETTERS).split() if text else []


SEGMENT = "segment long, doc_ids array<long>, text_keys array<long>, n_words array<long>, terms binary, ends binary, counts binary, postings binary"


def _segment_batch(number: int, docs: list, ids: list[np.ndarray], terms: list[bytes]) -> pa.RecordBatch:
    """A segment of documents whose words are ``ids`` into ``terms``. The number of empty positions
    between two documents is one, so that no phrase runs over an edge unnoticed."""
    sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
    starts = np.cumsum(sizes + 1) - sizes - 1
    every = np.concatenate(ids)
    places = np.repeat(starts, sizes) + np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    by_name = sorted(range(len(terms)), key=terms.__getitem__)
    rank = np.empty(len(terms), np.int64)
    rank[by_name] = np.arange(len(terms))
    every = rank[every] if len(every) else every
    order = np.argsort(every, kind="stable")
    counts = np.bincount(every, minlength=len(terms)).astype("<i4")
    gaps = np.diff(places[order], prepend=0).astype("<i4")  # small numbers pack well
    blob, ends = b"".join([terms[i] for i in by_name]), np.cumsum([len(terms[i]) for i in by_name], dtype="<i8")
    columns = [[number], [[d for d, _ in docs]], [[k for _, k in docs]], [sizes], [blob], [ends.tobytes()], [counts.tobytes()], [gaps.tobytes()]]
    long = pa.list_(pa.int64())
    types = [pa.int64(), long, long, long, *[pa.large_binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t).cast(pa.binary()) if t == pa.large_binary() else pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in SEGMENT.split(", ")])


def _segments(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33  # each task numbers its own
    docs, ids, size, terms = [], [], 0, defaultdict(count().__next__)  # a new word gets the next number
    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(c) for c in ("doc_id", "text_key", "text")), strict=True):
            found = words(text.as_py())
            docs.append((doc_id.as_py(), key.as_py()))
            ids.append(np.fromiter(map(terms.__getitem__, found), np.int64, len(found)))
            size += len(found) + 1
            if size >= SEGMENT_WORDS:
                yield _segment_batch(number, docs, ids, list(terms))
                number += 1
                docs, ids, size, terms = [], [], 0, defaultdict(count().__next__)
    if docs:
        yield _segment_batch(number, docs, ids, list(terms))


def index(docs: DataFrame) -> DataFrame:
    """The segments of the positional index of all words of ``docs``, written to the shared folder."""
    small_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("text_key"), docs["text"].alias("text"))
    return staged(narrow.mapInArrow(_segments, SEGMENT), "postings")


class _Terms:
    """The terms of a segment; their numbers are found by binary search."""

    def __init__(self, terms: bytes, ends: bytes):
        self.blob, self.ends = terms, np.frombuffer(ends, "<i8")

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, i: int) -> bytes:
        return self.blob[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]

    def present(self, vocabulary: list[bytes]) -> list[tuple[int, int]]:
        """(place in the vocabulary, number in the segment) of the words of a sorted vocabulary that are there."""
        if len(vocabulary) * 16 < len(self):
            found = ((v, bisect_left(self, w)) for v, w in enumerate(vocabulary))
            return [(v, i) for v, i in found if i < len(self) and self[i] == vocabulary[v]]
        number = {self[i]: i for i in range(len(self))}
        return [(v, number[w]) for v, w in enumerate(vocabulary) if w in number]


def term_counts(segments: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """How often each word of a sorted vocabulary occurs in all documents."""
    sent = segments.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, ends, counts in zip(*(batch.column(c) for c in ("terms", "ends", "counts")), strict=True):
                pairs = np.array(_Terms(terms.as_py(), ends.as_py()).present(sent.value), np.int64).reshape(-1, 2)
                total[pairs[:, 0]] += np.frombuffer(counts.as_py(), "<i4")[pairs[:, 1]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    summed = segments.select("terms", "ends", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = np.zeros(len(vocabulary), np.int64)
    for row in summed.toLocalIterator():
        total[row.term] = row.n
    return total


def _phrases(items: list[tuple], window: int) -> list[tuple[object, list[bytes]]]:
    return [(i, w[k : k + window]) for i, w in items for k in range(max(1, len(w) - window + 1)) if w]


class _Lookup:
    """Phrases by their rarest term, with the order in which their terms are intersected."""

    def __init__(self, phrases, vocabulary, counts):
        self.by_rarest, self.vocabulary = defaultdict(list), vocabulary
        numbers = {w: i for i, w in enumerate(vocabulary)}
        for item, phrase in phrases:
            terms = [numbers[w] for w in phrase]
            order = sorted(range(len(terms)), key=lambda k: (counts[terms[k]], k))
            if counts[terms[order[0]]]:
                self.by_rarest[terms[order[0]]].append((item, terms, order))


def _has(postings: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(postings, wanted)
    return postings[np.minimum(at, len(postings) - 1)] == wanted


def exact_starts(postings: dict, terms: list[int], order: list[int]) -> np.ndarray:
    """Positions at which the phrase starts: offset-adjusted lists intersected from the rarest on."""
    starts = postings[terms[order[0]]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        other = postings.get(terms[k])
        if other is None:
            return starts[:0]
        starts = starts[_has(other, starts + k)]
    return starts


def proximity_spans(postings: dict, terms: list[int], order: list[int], slop: int) -> list[tuple[int, int]]:
    """Tightest spans (first, last position) around each occurrence of the rarest term that
    hold all terms in order within ``slop`` extra words."""
    middle = order[0]
    low = high = postings[terms[middle]]
    for k in range(middle + 1, len(terms)):
        other = postings.get(terms[k])
        if other is None:
            return []
        at = np.searchsorted(other, high, side="right")
        inside = at < len(other)
        low, high = low[inside], other[at[inside]]
    for k in range(middle - 1, -1, -1):
        other = postings.get(terms[k])
        if other is None:
            return []
        at = np.searchsorted(other, low, side="left") - 1
        inside = at >= 0
        low, high = other[at[inside]], high[inside]
    near = high - low < len(terms) + slop
    return sorted(set(zip(low[near].tolist(), high[near].tolist(), strict=True)))


MATCH = "struct<item_id: string, start: long, end: long, kind: string>"


def _match(lookup, slop: int):
    """Maps segments to segment, doc (its place there) and matches of the documents that have any."""
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        by_rarest, vocabulary = lookup.value.by_rarest, lookup.value.vocabulary
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_words"], np.int64)
                starts = np.cumsum(sizes + 1) - sizes - 1
                counts = np.frombuffer(row["counts"], "<i4")
                gaps, ends = np.frombuffer(row["postings"], "<i4"), np.cumsum(counts)
                every = np.cumsum(gaps, dtype=np.int64)
                postings = {v: every[ends[i] - counts[i] : ends[i]] for v, i in _Terms(row["terms"], row["ends"]).present(vocabulary)}
                found = defaultdict(list)  # by document: item, first and last position
                for term in postings.keys() & by_rarest.keys():
                    for item, phrase, order in by_rarest[term]:
                        spans = [(s, s + len(phrase) - 1, "exact") for s in exact_starts(postings, phrase, order).tolist()]
                        if slop:
                            spans += [(s, e, "proximity") for s, e in proximity_spans(postings, phrase, order, slop) if e - s >= len(phrase)]
                        for s, e, what in spans:
                            doc = int(np.searchsorted(starts, s, side="right")) - 1
                            if e < starts[doc] + sizes[doc]:
                                found[doc].append((item, s - int(starts[doc]), e - int(starts[doc]) + 1, what))
                matched = [[dict(zip(("item_id", "start", "end", "kind"), m, strict=True)) for m in ms] for ms in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * len(found), pa.int64()), pa.array(list(found), pa.int32()), pa.array(matched, kind)], ["segment", "doc", "matches"])

    return run


def probe(segments: DataFrame, items: list[tuple], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """segment, doc and matches for a block of items (id and words)."""
    phrases = _phrases(items, window)
    vocabulary = sorted({w for _, phrase in phrases for w in phrase})
    counts = term_counts(segments, vocabulary) if vocabulary else np.zeros(0, np.int64)
    lookup = segments.sparkSession.sparkContext.broadcast(_Lookup(phrases, vocabulary, counts))
    return segments.mapInArrow(_match(lookup, slop), f"segment long, doc int, matches array<{MATCH}>")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, item_block: int = ITEM_BLOCK, unnamed: bool = False) -> DataFrame:
    """One row per document: doc_id, text_key, n_words and its matches, as spans of word positions (end excluded)."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].alias("text")).filter("text is not null")
    items = items if unnamed else items.filter("item_id is not null")
    segments = index(docs)
    found, block = [], []
    for row in items.toLocalIterator():  # the query set, a block at a time
        block.append((row.item_id, words(row.text)))
        if len(block) >= item_block:
            found.append(staged(probe(segments, block, window, slop), "matches"))
            block = []
    if block or not found:
        found.append(staged(probe(segments, block, window, slop), "matches"))
    by_doc = reduce(DataFrame.unionByName, found).groupBy("segment", "doc").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    directory = segments.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("doc", "d"))
    none = F.array().cast(f"array<{MATCH}>")
    joined = directory.join(by_doc, ["segment", "doc"], "left")
    return joined.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.n_words").alias("n_words"), F.coalesce("matches", none).alias("matches"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit (words inside an exact match), items (sorted as strings)."""
    exact = F.filter("matches", lambda m: m["kind"] == "exact")
    spans = F.array_sort(F.transform(exact, lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["upto"], x["s"]))).alias("n")),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform(exact, lambda m: m["item_id"]))))
    return found.select("doc_id", "text_key", "n_words", covered.alias("n_hit"), items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, with their own columns."""
    found = report(matches(docs, benchmark, unnamed=True))
    return keep_rows(docs, staged(found.select("doc_id", "text_key", (F.col("n_hit") == 0).alias("kept")), "decided"))
