"""SimHash near-dedup with pivot distance tables.

Each text becomes a 64-bit fingerprint; fingerprints with at most ``RADIUS`` differing
bits are linked, and documents are grouped by reachability over links.

A table of Hamming distances from every distinct fingerprint to ``PIVOTS`` fixed reference
fingerprints is computed once and stored with the fingerprints. By the triangle inequality two
fingerprints within RADIUS bits differ by at most RADIUS in every coordinate of that table, so a
pair whose largest coordinate difference is greater is discarded unseen; the survivors are
verified on the fingerprints themselves.

Which pairs are put to that test is bounded without loss: the 64 bits are cut into blocks,
RADIUS differing bits leave at least (blocks - RADIUS) blocks untouched, so linked fingerprints
meet under the key of some choice of so many blocks. Distances to a pivot cannot form the pairs by
themselves: those of 64-bit fingerprints concentrate around 32, and a coordinate tells apart fewer
than half of all pairs, so that meeting by coordinates would take a look at all. The more blocks,
the more and the longer the keys; ``blocks_for`` takes as few as keep keys of strangers small.
Rows are distinct fingerprints, however many copies they stand for. A key with more than
``CHUNK`` fingerprints is cut into chunks, and pairs of chunks are compared in tasks of
their own; no link is lost and no list of pairs is made, as each task returns only a
spanning forest of the links it found.

Defined cases: null, empty and white-space-only texts have fingerprint zero and are linked
like any other; texts of fewer than four words have one shingle, the whole sequence. Null
doc_ids are grouped with the others, but a component_id is null only if no row of the
component has a doc_id. Repeated rows are all returned. Texts of any length are read whole. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm._shared import HOT_SHARE, join_hot, keep_rows, small_batches, staged, text_key

WORDS = 4
SEED = 42
RADIUS = 4
PIVOTS = 24
#: Fingerprints that may meet under a key by chance.
STRANGERS = 8
CHUNK = 2048
SALTS = 8
#: Words hashed at a time, so that a text of any length needs bounded memory.
SPAN = 200_000


def fingerprint(text: str | None) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    counts, total = np.zeros(64, np.int64), 0
    for at in range(0, max(1, len(words) - WORDS + 1), SPAN):
        part = words[at : at + SPAN + WORDS - 1]
        joined = b" ".join(part)
        ends = [*accumulate(map(len, part), lambda a, b: a + b + 1)]
        starts = [0, *(e + 1 for e in ends)]
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts, ends[min(WORDS, len(part)) - 1 :], strict=False)], np.uint64)
        total += len(hashes)
        counts += _bit_counts(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set. Bits are spread to bytes, 255 rows of which are added as words."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(prints)], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("text_key"), docs["text"].alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Fixed pivots spread over the space: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64)


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


#: Eight coordinates are kept in a long.
COORDINATES = [f"c{i}" for i in range(-(-PIVOTS // 8))]


def _coordinates(batches):
    pivots = reference_fingerprints(8 * len(COORDINATES))
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        packed = np.ascontiguousarray(pivot_table(fp.view(np.uint64), pivots)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp), *[pa.array(np.ascontiguousarray(c)) for c in packed.T]], ["fp", *COORDINATES])


def with_coordinates(prints: DataFrame) -> DataFrame:
    """fp (distinct fingerprints) with its row of the pivot table, packed."""
    return prints.select("fp").mapInArrow(_coordinates, ", ".join(f"{c} long" for c in ("fp", *COORDINATES)))


def _unpacked(columns) -> np.ndarray:
    return np.stack(columns, axis=1).view(np.int8)


def blocks_for(n: int, radius: int = RADIUS, strangers: int = STRANGERS) -> int:
    """The fewest blocks whose keys are long enough that n random fingerprints fill them with ``strangers`` each."""
    return next(b for b in range(radius + 1, 65) if b == 64 or n <= strangers * 2 ** (64 * (b - radius) / b))


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """A bit mask for each choice of ``blocks - radius`` of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of positions a and b those that are linked. ``seen`` takes the numbers of pairs
    that met, that the pivots left, and that are linked."""
    met = len(a)
    for column in table.T:  # the largest coordinate difference, coordinate by coordinate
        near = np.abs(column[a] - column[b]) <= radius
        a, b = a[near], b[near]
    near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
    if seen is not None:
        seen.append((met, len(a), int(near.sum())))
    return a[near], b[near]


def _forest(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, smallest fp reached) that connect what the links a, b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(nodes))
    return prints[nodes[child]], prints[nodes[label[child]]]


FOUND = "a long, b long, table int, key long, chunk int, " + ", ".join(f"{c} long" for c in COORDINATES)


def _rows(a, b, table=None, key=None, chunk=None, coordinates=None):
    n = len(a)
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64())] if b is not None else [pa.array(a, pa.int64()), pa.nulls(n, pa.int64())]
    more = [(table, pa.int32()), (key, pa.int64()), (chunk, pa.int32()), *[(c, pa.int64()) for c in coordinates or [None] * len(COORDINATES)]]
    columns += [pa.nulls(n, t) if x is None else pa.array(np.full(n, x) if np.isscalar(x) else x, t) for x, t in more]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _within_keys(radius: int, chunk: int, seen: list | None = None):
    """Maps rows (table, key, fp, coordinates) sorted by (table, key) to links within each key, or, for a key of more than
    ``chunk`` rows, to its rows with chunk numbers."""

    def links(table, key, fp, *packed):
        """Of whole keys with at most ``chunk`` rows each."""
        starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        if not len(starts):
            return None
        rows = np.repeat(starts, sizes) + _ramp(sizes)
        prints = fp[rows].view(np.uint64)
        ends = np.repeat(np.cumsum(sizes), sizes)  # of a row's key, among the rows
        after = ends - np.arange(len(rows)) - 1  # rows of the key after this one
        coordinates = _unpacked([c[rows] for c in packed])
        found_a, found_b, at = [], [], 0
        while at < len(rows):  # about a million pairs at a time
            upto = max(at + 1, int(np.searchsorted(np.cumsum(after[at:]), 1_000_000)) + at)
            a = np.repeat(np.arange(at, upto), after[at:upto])
            b = a + 1 + _ramp(after[at:upto])
            a, b = _linked(prints, coordinates, a, b, radius, seen)
            found_a.append(a)
            found_b.append(b)
            at = upto
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if not len(a):
            return None
        child, parent = _forest(prints, a, b)
        return _rows(child.view(np.int64), parent.view(np.int64))

    def run(batches):
        held: list[tuple] = []  # rows of the last key so far, fewer than two chunks
        large: tuple | None = None  # the key that is being passed on in chunks
        passed = 0
        for batch in batches:
            new = tuple(batch.column(i).to_numpy() for i in range(3 + len(COORDINATES)))
            if not len(new[0]):
                continue
            every = [np.concatenate(x) for x in zip(*held, new, strict=True)] if held else new
            table, key, fp, *packed = every
            held = []
            last = int(np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])[-1])
            starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            small = np.ones(len(fp), bool)
            for s, e in zip(starts, ends, strict=True):
                continues = large == (table[s], key[s])
                if continues or e - s > chunk:
                    if not continues:
                        large, passed = (table[s], key[s]), 0
                    number = (passed + np.arange(e - s)) // chunk
                    yield _rows(fp[s:e], None, table[s], key[s], number, [c[s:e] for c in packed])
                    passed += e - s
                    small[s:e] = False
            if small[last]:  # may go on in the next batch
                held = [tuple(c[last:] for c in every)]
                small[last:] = False
            if small.any():
                out = links(*[c[small] for c in every])
                if out is not None:
                    yield out
        if held:
            out = links(*held[0])
            if out is not None:
                yield out

    return run


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _between_chunks(radius: int):
    def run(key, rows):
        side = rows.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        both = rows.column("fp").to_numpy()[order].view(np.uint64)
        left = both[: int((side == 0).sum())]
        same = len(left) == len(both)  # a chunk with itself
        coordinates = _unpacked([rows.column(c).to_numpy()[order] for c in COORDINATES])
        found_a, found_b = [], []
        for i in range(len(left)):
            b = np.arange(i + 1, len(left)) if same else np.arange(len(left), len(both))
            a, b = _linked(both, coordinates, np.full(len(b), i), b, radius)
            found_a.append(a)
            found_b.append(b)
        child, parent = _forest(both, np.concatenate(found_a), np.concatenate(found_b))
        return pa.table({"a": pa.array(child.view(np.int64), pa.int64()), "b": pa.array(parent.view(np.int64), pa.int64())})

    return run


def links(table: DataFrame, radius: int = RADIUS, blocks: int = 7, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) over distinct fingerprints with their coordinates, whose connected components are those of all links."""
    masks = block_masks(blocks, radius)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])
    keyed = table.select("fp", *COORDINATES, F.posexplode(keys).alias("table", "key")).select("table", "key", "fp", *COORDINATES)
    sorted_ = keyed.repartition("table", "key").sortWithinPartitions("table", "key")
    found = staged(sorted_.mapInArrow(_within_keys(radius, chunk), FOUND), "links_within_keys")
    inner = found.filter("b is not null").select("a", "b")
    large = found.filter("b is null").select(F.col("a").alias("fp"), "table", "key", "chunk", *COORDINATES)
    chunks = large.select("table", "key", "chunk").distinct()
    left, right = chunks.withColumnRenamed("chunk", "i"), chunks.withColumnRenamed("chunk", "j")
    tasks = left.join(right, ["table", "key"]).filter("i <= j")  # of chunks, not of rows
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("j").alias("chunk"), F.lit(1).alias("side")))
    )
    tasks = tasks.select("table", "key", "i", "j", F.explode(sides).alias("s")).select("table", "key", "i", "j", "s.chunk", "s.side")
    compared = large.join(tasks, ["table", "key", "chunk"]).groupBy("table", "key", "i", "j")
    outer = compared.applyInArrow(_between_chunks(radius), "a long, b long")
    return inner.unionByName(outer)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for the nodes of undirected edges (a, b).

    Alternating large-star and small-star steps; each step is a grouped minimum, with the
    partial sums of a hot node merged map-side, and a join whose rows are salted."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = staged(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _salted(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: every node and its smaller neighbours point to the smallest of them
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _salted(large, lows).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = staged(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        if _same(edges, new):
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new


def _salted(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows (a, b) joined with side (a, m): a hot node's rows go to SALTS tasks."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.select("a", "b", salt).join(side.select("a", "m", copies), ["a", "salt"])


def _same(old: DataFrame, new: DataFrame) -> bool:
    def state(edges):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()

    return state(old) == state(new)


def groups(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, text_key, fp, component_id and kept (true for one row of a component)."""
    rows = staged(fingerprints(docs).withColumn("row_id", F.monotonically_increasing_id()), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_id"))
    prints = staged(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "prints")
    table = staged(with_coordinates(prints), "pivot_table")
    found = staged(components(links(table, radius, blocks or blocks_for(table.count(), radius), chunk)), "components")
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    least = prints.join(members, prints["fp"] == members["node"]).groupBy("root").agg(F.min("first").alias("m"))
    labels = _salted(members.select(F.col("root").alias("a"), F.col("node").alias("b")), least.withColumnRenamed("root", "a"))
    side = prints.join(labels.select(F.col("b").alias("fp"), "m"), "fp", "left").select("fp", "n", F.coalesce("m", "first").alias("best"))
    side = staged(side, "sides")
    total = side.agg(F.sum("n")).first()[0] or 0
    hot = side.filter(F.col("n") * HOT_SHARE > total).drop("n")
    joined = join_hot(rows, side.drop("n"), hot, "fp")
    return joined.select("doc_id", "text_key", "fp", F.col("best.doc_id").alias("component_id"), (F.col("row_id") == F.col("best.row_id")).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with its own columns."""
    return keep_rows(docs, staged(groups(docs).select("doc_id", "text_key", "kept"), "decided"))
