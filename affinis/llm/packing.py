"""Best-fit packing of tokenised documents into sequences, with swap-based local search.

Every text is tokenised once into a table of pieces. A document is its ids and an end id;
only one longer than a sequence is cut, into full sequences after a first piece that takes
the remainder, so all pieces but the first fill a sequence by themselves. The other pieces
are dealt by hash to groups of about ``GROUP`` pieces, and a task packs each group:

1. best-fit decreasing: each piece goes to the fullest sequence that has room for it;
2. local search among sequences that are not full: from the emptiest, pieces are moved to
   others, exchanged one for one, or two for one, whenever that makes the fuller of the two
   fuller (the sum of squared fills grows with every step, so the search ends), until
   sequences empty. A sequence that cannot be emptied keeps the exchanges that help others.

Groups lose at most the unfilled remainder of their last sequences; with tens of thousands of
pieces in each that is well under one in a thousand, and no group grows with the input.

Ids are those of ``tokenizers``. Byte-pair merging by ``tiktoken`` over the same vocabulary gives the
same ids about three times as fast, but its pattern matcher fails on runs of hundreds of thousands of
blanks; a text with a run of ``BLANKS`` or more is encoded by ``tokenizers`` itself.

Defined cases: a null text is empty and becomes a document of only the end id; texts of any length
are encoded whole, one text at a time; repeated rows are packed once each, and pieces of equal length are packed in the order of rows; null doc_ids are packed like others. Other columns are not
looked at. An empty table gives no sequences.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import defaultdict
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm._shared import small_batches, staged

LENGTH = 2048
GROUP = 20_000
END = 0
#: A run of white space that is left to ``tokenizers``.
BLANKS = re.compile(r"\s{50000}")
#: The fullest open sequences that are looked at one by one for an exchange, before all are at once.
NEIGHBOURS = 200


@cache
def encoder(path: str, special: bool = True):
    """text -> ids of the byte-level BPE in ``path`` (a ``tokenizers`` JSON file, or the same
    vocabulary as tiktoken ranks beside it, which gives the same ids about five times as fast).

    With ``special`` a special token's string in a text becomes its id, as ``tokenizers`` does by default."""
    from public_tokenizers import PATTERN

    model = json.loads(Path(path).read_text())
    bytes_of = {c: b for b, c in _byte_letters().items()}
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(bytes_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if len(text) >= 50_000 and BLANKS.search(text):
            return _tokenizer(path, special).encode(text, add_special_tokens=False).ids
        if special and any(t in text for t in added):
            return bpe.encode(text, allowed_special=set(added), disallowed_special=())
        return bpe.encode_ordinary(text)

    return encode


@cache
def _tokenizer(path: str, special: bool):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = not special
    return found


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE files write for bytes: printable ones stand for themselves."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return letters


PIECE = "doc_id long, row_id long, piece int, start long, length long, ids binary"


def _pieces(path: str, length: int, end: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            out = []
            for doc_id, row_id, text in zip(*(batch.column(c) for c in ("doc_id", "row_id", "text")), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                first = len(ids) if len(ids) <= length else len(ids) % length or length
                starts = [0, *range(first, len(ids), length)]
                for k, s in enumerate(starts):
                    part = ids[s : first if k == 0 else s + length]
                    out.append((doc_id.as_py(), row_id.as_py(), k, s, len(part), part.tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "row_id", "piece", "start", "length", "ids"])

    return run


def tokenised(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit), in the shared folder."""
    small_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), docs["text"].alias("text"))
    return staged(narrow.mapInArrow(_pieces(tokenizer, length, end), PIECE), "pieces")


class Bins:
    """Sequences as lists of (length, item), by free room."""

    def __init__(self, length: int):
        self.length, self.bins, self.free = length, [], []
        self.by_free: dict[int, set[int]] = defaultdict(set)
        self.some = 0  # bit r is set if a bin has r free
        self.table = None  # of the pieces in open bins, until an exchange

    def place(self, at: int, free: int) -> None:
        old = self.free[at]
        self.by_free[old].discard(at)
        if not self.by_free[old]:
            self.some &= ~(1 << old)
        self.free[at] = free
        self.by_free[free].add(at)
        self.some |= 1 << free

    def best_fit(self, size: int, item: int) -> None:
        room = self.some >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            at = next(iter(self.by_free[free]))
        else:
            at = len(self.bins)
            self.bins.append([])
            self.free.append(self.length)
            self.by_free[self.length].add(at)
            self.some |= 1 << self.length
        self.bins[at].append((size, item))
        self.place(at, self.free[at] - size)

    def exchange(self, a: int, out: list, b: int, back: list) -> None:
        """Entries ``out`` of bin a go to bin b, and entries ``back`` of b to a."""
        self.table = None
        for x in out:
            self.bins[a].remove(x)
            self.bins[b].append(x)
        for y in back:
            self.bins[b].remove(y)
            self.bins[a].append(y)
        change = sum(x[0] for x in out) - sum(y[0] for y in back)
        self.place(a, self.free[a] + change)
        self.place(b, self.free[b] - change)

    def pieces(self, open_: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, length and the bin's free room of every piece in an open bin, the fullest bins first."""
        if self.table is None:
            rows = [(at, x[0], self.free[at]) for at in reversed(open_) if self.free[at] for x in self.bins[at]]
            self.table = tuple(np.array(rows, np.int64).reshape(-1, 3).T)
        return self.table


def local_search(bins: Bins) -> int:
    """Moves and exchanges pieces between open bins until none helps; returns the steps taken."""
    steps = 0
    while True:  # every step raises the sum of squared fills, which is bounded
        bins.table = None
        open_ = sorted((at for at in range(len(bins.bins)) if bins.bins[at] and bins.free[at]), key=lambda at: (-bins.free[at], at))
        before = steps
        for giver in open_:
            if bins.bins[giver] and bins.free[giver]:
                steps += _unload(bins, giver, open_)
        if steps == before:
            break
    return steps


def _unload(bins: Bins, giver: int, open_: list[int]) -> int:
    """Steps by which other bins, at least as full as the giver, get fuller from it."""
    steps = 0
    while bins.bins[giver]:
        step = _move(bins, giver) or _swap(bins, giver, open_)
        if not step:
            break
        bins.exchange(giver, *step)
        steps += 1
    return steps


def _move(bins: Bins, giver: int):
    """The longest piece that another bin has room for, into the fullest such bin."""
    for entry in sorted(bins.bins[giver], reverse=True):
        room = (bins.some >> entry[0]) << entry[0]
        while room:
            free = (room & -room).bit_length() - 1
            if free > bins.free[giver]:
                break  # only into bins at least as full
            at = next((b for b in bins.by_free[free] if b != giver and bins.bins[b]), None)
            if at is not None:
                return [entry], at, []
            room &= room - 1
    return None


def _swap(bins: Bins, giver: int, open_: list[int]):
    """The exchange of one or two of the giver's pieces for a shorter piece that fills another
    bin most: of the first of the NEIGHBOURS fullest open bins that has one, or else of any."""
    entries = sorted(bins.bins[giver], reverse=True)
    given = {e[0]: [e] for e in entries}
    # a length makes at most one pair with itself, and a bin has few lengths
    once = [e for i, e in enumerate(entries) if i < 2 or entries[i - 2][0] != e[0]]
    for i, x in enumerate(once):
        for y in once[i + 1 :]:
            given.setdefault(x[0] + y[0], [x, y])
    sums = sorted(given)
    tried = 0
    for at in reversed(open_):  # the fullest first
        free = bins.free[at]
        if at == giver or not free or free > bins.free[giver] or not bins.bins[at]:
            continue
        tried += 1
        if tried > NEIGHBOURS:
            return _swap_any(bins, giver, open_, given, sums)
        best, gain = None, 0
        for back in bins.bins[at]:
            i = bisect_right(sums, back[0] + free) - 1
            if i >= 0 and sums[i] - back[0] > gain:
                best, gain = (given[sums[i]], at, [back]), sums[i] - back[0]
        if best:
            return best
    return None


def _swap_any(bins: Bins, giver: int, open_: list[int], given: dict, sums: list[int]):
    """The exchange that fills the fullest bin with one most, among all open bins."""
    at, back, free = bins.pieces(open_)
    fits = np.searchsorted(sums, back + free, side="right") - 1
    gain = np.where((fits >= 0) & (at != giver) & (free <= bins.free[giver]), np.array(sums)[fits] - back, 0)
    better = np.flatnonzero(gain > 0)
    if not len(better):
        return None
    same = better[at[better] == at[better[0]]]
    i = same[np.argmax(gain[same])]
    return given[sums[fits[i]]], int(at[i]), [next(x for x in bins.bins[at[i]] if x[0] == back[i])]


def pack(lengths: list[int], length: int = LENGTH) -> list[list[int]]:
    """The items of each sequence."""
    bins = Bins(length)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins.best_fit(lengths[item], item)
    local_search(bins)
    return [[item for _, item in b] for b in bins.bins if b]


PLACED = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack_group(length: int, n_groups: int):
    def run(key, rows):
        order = np.lexsort([rows.column("piece").to_numpy(), rows.column("row_id").to_numpy()])  # whatever order they came in
        rows = rows.take(pa.array(order))
        lengths = rows.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        group = key[0].as_py()
        for n, items in enumerate(pack(lengths, length)):
            at = 0
            for i in items:
                sequence[i], offset[i] = n * n_groups + group, at
                at += lengths[i]
        out = {c: rows.column(c) for c in ("doc_id", "row_id", "piece", "start", "length", "ids_crc32")}
        return pa.table(out | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return run


def placements(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Where each piece goes: its sequence_id and the offset there. The ids themselves stay where they are."""
    narrow = pieces.select("doc_id", "row_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    part = narrow.filter(F.col("length") < length)
    groups = max(1, -(-part.count() // group))
    dealt = part.withColumn("group", F.pmod(F.xxhash64("row_id", "piece"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(_pack_group(length, groups), PLACED)
    # a full piece is a sequence of its own, numbered below zero
    number, none = (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    alone = narrow.filter(F.col("length") == length).select("*", number, none)
    return packed.unionByName(alone)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence (little-endian unsigned 32-bit), for training."""
    where = placed.select("row_id", "piece", "sequence_id", "offset")
    entry = F.struct("offset", F.hex("ids").alias("ids"))
    parts = F.array_sort(F.collect_list(entry))  # a sequence has at most as many pieces as tokens
    joined = pieces.join(where, ["row_id", "piece"]).groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))
