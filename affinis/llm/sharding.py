"""Resharding by minimum-cost flow.

The files of a table are its old shards. Each old shard has a home among the new ones
(its number, modulo their count), where keeping a byte costs nothing; a byte that goes
anywhere else costs one. With the old sizes as supplies and the new capacities as
demands, a minimum-cost flow gives the bytes that go from each old shard to each new one,
and so the fewest that have to move.

Bytes move in blocks: runs of consecutive rows of a file, about ``BLOCKS`` of them
in all whatever the input's size (single rows if there are fewer), so that sizes meet the flow to within a block, and exchanges of blocks then even out what rounding left: new shards of equal
capacity are at most one block apart (1/BLOCKS of the bytes, or the largest row if that is more), and
usually within a byte. Blocks are known by file and row position, so rows find their shard and slot without a shuffle or
a sort. Only files that lose a block, or that arrive at a shard which needs a new slot order,
are rewritten; the others are referred to in the manifest.

Law: ``bytes`` (sizes of the new shards near equal).

Defined cases: a null text counts as no bytes and has the CRC of no bytes; each row adds
one byte; repeated rows, rows of equal size and rows without doc_id are placed by file and position, each by
itself; a text of any length is one row and never cut; a row's other columns, whatever their names, go along in the struct ``row``. An
empty table gives empty shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm._shared import stage_path

SHARDS = 8
BLOCKS = 65_536
#: Rows of the block map that may be broadcast (it has BLOCKS rows and one per file).
MAP_ROWS = 2_000_000
EXCHANGES = 500


def min_cost_flow(supply: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Integer flows (old x new) that ship all supply within capacity at the least cost.

    Successive shortest paths: each round finds the cheapest path from an old shard with
    supply to a new one with room, through flows already set, and pushes as much as fits."""
    supply, capacity = supply.astype(np.int64).copy(), capacity.astype(np.int64).copy()
    if supply.sum() > capacity.sum():
        raise ValueError("capacities are smaller than the data")
    flow = np.zeros(cost.shape, np.int64)
    while supply.any():
        old = np.where(supply > 0, 0, np.inf)
        new, came = np.full(len(capacity), np.inf), np.full(len(capacity), -1)
        through = np.full(len(supply), -1)
        while True:  # shortest distances; residual arcs back have negative cost
            reach = old[:, None] + cost
            best = reach.argmin(axis=0)
            better = reach[best, np.arange(len(new))] < new - 1e-9
            if not better.any():
                break
            new[better], came[better] = reach[best, np.arange(len(new))][better], best[better]
            back = np.where(flow > 0, new[None, :] - cost, np.inf)
            least = back.argmin(axis=1)
            nearer = back[np.arange(len(old)), least] < old - 1e-9
            old[nearer], through[nearer] = back[np.arange(len(old)), least][nearer], least[nearer]
        end = int(np.where(capacity > 0, new, np.inf).argmin())
        path, j = [], end
        while True:
            i = int(came[j])
            path.append((i, j, 1))
            if through[i] < 0:
                break
            j = int(through[i])
            path.append((i, j, -1))
        amount = min([supply[path[-1][0]], capacity[end], *(flow[i, j] for i, j, sign in path if sign < 0)])
        for i, j, sign in path:
            flow[i, j] += sign * amount
        supply[path[-1][0]] -= amount
        capacity[end] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> np.ndarray:
    return np.full(shards, total // shards, np.int64) + (np.arange(shards) < total % shards)


def assign_blocks(old: np.ndarray, size: np.ndarray, home: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The new shard of each block (its old shard and bytes): blocks follow the minimum-cost flow.

    Old shards of one home have the same costs, so they are one source of the flow, which has as
    many sources as new shards however many files there are. The blocks of a home, file by file,
    stay until its flow to itself is used up, and the rest goes where its other flows say, so
    few files lose a block; at each change of target at most half a block is rounded."""
    n_new = len(capacity)
    of_home = home[old]
    supply = np.bincount(of_home, weights=size, minlength=n_new).astype(np.int64)
    here = np.arange(n_new)
    flow = min_cost_flow(supply, capacity, (here[None, :] != here[:, None]).astype(float))
    shard = np.empty(len(old), np.int64)
    for h in range(n_new):
        mine = np.flatnonzero(of_home == h)
        mine = mine[np.argsort(old[mine], kind="stable")]
        targets = np.r_[h, np.delete(here, h)]
        middle = np.cumsum(size[mine]) - size[mine] / 2
        at = np.searchsorted(np.cumsum(flow[h][targets]), middle, side="right")
        shard[mine] = targets[np.minimum(at, np.flatnonzero(flow[h][targets])[-1])] if len(mine) else 0
    _even_out(shard, size, capacity)
    return shard


def _even_out(shard: np.ndarray, size: np.ndarray, capacity: np.ndarray) -> None:
    """Moves a block, or exchanges two, between the fullest and the emptiest shard while that evens them out.

    While the two are more than the largest block apart, moving a block helps; rounding leaves each shard
    within as many blocks as there are shards, so far fewer than EXCHANGES steps bring all within one block."""
    for _ in range(EXCHANGES):
        over = np.bincount(shard, weights=size, minlength=len(capacity)).astype(np.int64) - capacity
        a, b = int(over.argmax()), int(over.argmin())
        gap = over[a] - over[b]
        mine, theirs = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        if gap <= 1 or not len(mine):
            return
        theirs = theirs[np.argsort(size[theirs], kind="stable")]
        options = [(abs(gap - 2 * size[m]), m, -1) for m in mine[[np.abs(gap - 2 * size[mine]).argmin()]]]
        if len(theirs):
            at = np.clip(np.searchsorted(size[theirs], size[mine] - gap / 2), 0, len(theirs) - 1)
            left = np.abs(gap - 2 * (size[mine] - size[theirs[at]]))
            best = int(left.argmin())
            options.append((left[best], mine[best], theirs[at[best]]))
        rest, x, y = min(options, key=lambda o: (o[0], o[2]))
        if rest >= gap:
            return
        shard[x] = b
        if y >= 0:
            shard[y] = a


@dataclass
class Plan:
    """blocks: file, block, shard, first_slot, moved; rows_per_block; bytes_moved and total bytes."""

    blocks: pd.DataFrame
    rows_per_block: int
    bytes_moved: int
    total: int


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _located(spark: SparkSession, path: str, rows_per_block: int) -> DataFrame:
    """The table's rows as a struct, with the file, the block and the place in the block of each."""
    df = spark.read.parquet(path)
    meta = df.metadataColumn("_metadata")
    place = meta["row_index"]
    return df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        F.xxhash64(meta["file_path"]).alias("file"),
        F.floor(place / rows_per_block).cast("long").alias("block"),
        (place % rows_per_block).alias("within"),
    )


def plan(spark: SparkSession, path: str, shards: int = SHARDS, capacities: np.ndarray | None = None, blocks: int = BLOCKS) -> Plan:
    """Sizes of blocks come to the driver (at most ``blocks`` and one per file), which solves the flow."""
    rows_per_block = max(1, -(-spark.read.parquet(path).count() // blocks))
    located = _located(spark, path, rows_per_block)
    sizes = located.groupBy("file", "block").agg(F.sum(byte_size(F.col("row.text"))).alias("size"), F.count("*").alias("n"))
    found = sizes.toPandas()
    table = spark.read.parquet(path)
    meta = table.metadataColumn("_metadata")["file_path"]
    names = table.select(F.xxhash64(meta).alias("file"), meta.alias("path")).distinct().collect()  # a row per file, as in the listing that the driver has
    number = {r["file"]: i for i, r in enumerate(sorted(names, key=lambda r: r["path"]))}
    found["old"] = found["file"].map(number).astype("int64")
    found = found.sort_values(["old", "block"], ignore_index=True)
    old, size = found["old"].to_numpy(), found["size"].to_numpy(np.int64)
    total = int(size.sum())
    home = np.arange(len(number)) % shards
    capacity = equal_capacities(total, shards) if capacities is None else capacities
    shard = assign_blocks(old, size, home, capacity) if len(found) else np.zeros(0, np.int64)
    found["shard"] = shard
    found["moved"] = shard != home[old] if len(found) else np.zeros(0, bool)
    n = found["n"].astype("int64")
    found["first_slot"] = n.groupby(found["shard"]).cumsum() - n
    return Plan(found[["file", "block", "shard", "first_slot", "moved"]], rows_per_block, int(size[found["moved"].to_numpy(bool)].sum()), total)


def placed(spark: SparkSession, path: str, plan: Plan) -> DataFrame:
    """Every row (struct ``row``) with its file, shard, slot and whether its block moves."""
    schema = "file long, block long, shard long, first_slot long, moved boolean"
    block_map = spark.createDataFrame(plan.blocks, schema) if len(plan.blocks) else spark.createDataFrame([], schema)
    if len(plan.blocks) <= MAP_ROWS:
        block_map = F.broadcast(block_map)
    rows = _located(spark, path, plan.rows_per_block).join(block_map, ["file", "block"])
    return rows.select("row", "file", F.col("shard").cast("int").alias("shard"), (F.col("first_slot") + F.col("within")).alias("slot"), "moved")


def reshard(spark: SparkSession, path: str, shards: int = SHARDS, capacities: np.ndarray | None = None, target: str | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Rewrites the affected files under ``target`` (by default in the shared folder), one directory a shard.

    A file whose blocks all stay is not copied: its rows are read where they are. Returns
    the resharded table as it then lies: row, shard and slot."""
    found = plan(spark, path, shards, capacities, blocks)
    rows = placed(spark, path, found)
    affected = found.blocks.loc[found.blocks["moved"], "file"].unique().tolist()
    if not affected:
        return rows.select("row", "shard", "slot")
    changed = rows.join(F.broadcast(spark.createDataFrame([(f,) for f in affected], "file long")), "file")
    target = target or stage_path(spark, "shards")
    changed.select("row", "shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(target)
    schema = rows.select("row", "slot", "shard").schema
    rewritten = spark.read.schema(schema).parquet(target).select("row", "shard", "slot")
    if len(affected) == found.blocks["file"].nunique():
        return rewritten
    kept = rows.join(F.broadcast(spark.createDataFrame([(f,) for f in affected], "file long")), "file", "left_anti")
    return rewritten.unionByName(kept.select("row", "shard", "slot"))
