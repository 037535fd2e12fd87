"""URL filter over a sorted digest array.

Rules are a host (it fits the host and all its subdomains) and a path prefix. Each rule's
string is hashed to 64 bits with XXH64; the sorted keys, with the offsets of the full strings
behind them, are one file that every task maps into memory: a temporary file of the task's own,
written from the broadcast and unlinked at once, as memory mapping needs a local file. For a url
all strings that a rule could have (each parent domain of at most as many labels as the longest
rule's host, with each path prefix as long as some rule's) are hashed and probed at once by binary search, and a hit counts only if the stored full string is
equal, so colliding keys cannot match. The longest matching rule gives the verdict; a url
that none fits is allowed, as it is not listed.

The file is sent to the tasks while the rules have at most ``RULE_BYTES`` bytes; a longer
list is cut into key ranges, each of them probed in turn in the same way.

Defined cases: a null url, and one without ``://``, has an empty host and path, and no rule
fits. A host or path of any length is looked at whole; what it costs grows with the labels and
paths that rules have, not with its own. Repeated urls are all returned, an empty table gives no rows; rules may repeat, and of equal ones with different
verdicts block wins. Other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
RULE_BYTES = 64_000_000
HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_and_path(url: str | None) -> tuple[str, str]:
    found = HOST.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def digest_array(rules: list[tuple[str, str]]) -> bytes:
    """The file: the number of rules, their sorted keys, the ends of their strings, verdicts, strings."""
    verdicts: dict[bytes, bool] = {}
    for rule, verdict in rules:
        verdicts[rule.encode()] = verdicts.get(rule.encode(), False) or verdict == BLOCK
    entries = sorted((xxhash.xxh64_intdigest(r), r, b) for r, b in verdicts.items())
    keys = np.array([k for k, _, _ in entries], "<u8")
    ends = np.cumsum([len(r) for _, r, _ in entries], dtype="<i8") if entries else np.zeros(0, "<i8")
    blocked = np.array([b for _, _, b in entries], np.uint8)
    return b"".join([np.array([len(entries)], "<i8").tobytes(), keys.tobytes(), ends.tobytes(), blocked.tobytes(), *(r for _, r, _ in entries)])


class DigestArray:
    """A digest array mapped from a file of the task, which is unlinked at once."""

    def __init__(self, data: bytes):
        with tempfile.NamedTemporaryFile(delete=False) as file:
            file.write(data)
        self.map = np.memmap(file.name, np.uint8, "r")
        os.unlink(file.name)
        n = int(self.map[:8].view("<i8")[0])
        self.keys = self.map[8 : 8 + 8 * n].view("<u8")
        self.ends = self.map[8 + 8 * n : 8 + 16 * n].view("<i8")
        self.blocked = self.map[8 + 16 * n : 8 + 17 * n]
        self.strings = self.map[8 + 17 * n :]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """For each probe the number of the rule that equals it, else -1."""
        out = np.full(len(probes), -1)
        if not len(self.keys) or not probes:
            return out
        keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], "<u8")
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # all rules of this key
                if self.string(k) == probes[i]:
                    out[i] = k
                k += 1
        return out

    def string(self, k: int) -> bytes:
        return self.strings[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes()


def probes_of(host: str, path: str, lengths: list[int], labels: int) -> list[str]:
    """The strings a fitting rule can have, for rules of at most ``labels`` host labels whose
    paths have these lengths. A longer suffix of the host equals no rule's host, and is not made."""
    if not host:
        return []
    tail = host.rsplit(".", labels)  # what is before the longest suffix a rule can have stays whole
    tail = tail[1:] if len(tail) > labels else tail
    parents = [".".join(tail[i:]) for i in range(len(tail))]
    return [p + path[:n] for p in parents for n in lengths if n <= len(path)]


JUDGED = "host string, path string, rule string, verdict string"


def _judge(sent, lengths, labels):
    @F.arrow_udf(JUDGED)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        listed = DigestArray(sent.value)
        for urls in batches:
            yield of_batch(listed, urls)

    def of_batch(listed: DigestArray, urls: pa.Array) -> pa.Array:
        parts = [host_and_path(u.as_py()) for u in urls]
        probes, owner = [], []
        for i, (host, path) in enumerate(parts):
            own = [p.encode() for p in probes_of(host, path, lengths, labels)]
            probes += own
            owner += [i] * len(own)
        rules: list[str | None] = [None] * len(parts)
        verdicts: list[str | None] = [None] * len(parts)
        found = listed.find(probes)
        for j in np.flatnonzero(found >= 0):
            i, rule = owner[j], probes[j].decode()
            if rules[i] is None or len(rule) > len(rules[i]):
                rules[i], verdicts[i] = rule, BLOCK if listed.blocked[found[j]] else ALLOW
        columns = [[h for h, _ in parts], [p for _, p in parts], rules, verdicts]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "path", "rule", "verdict"])

    return judge


def rule_blocks(rules: list[tuple[str, str]], most: int = RULE_BYTES) -> list[list[tuple[str, str]]]:
    """The rules by key, cut into ranges of at most ``most`` bytes; equal rules stay together."""
    blocks, size, last = [[]], 0, None
    for rule, verdict in sorted(rules, key=lambda r: (xxhash.xxh64_intdigest(r[0].encode()), r[0])):
        if size + len(rule.encode()) > most and rule != last:
            blocks.append([])
            size = 0
        blocks[-1].append((rule, verdict))
        size, last = size + len(rule.encode()) + 17, rule
    return blocks


def judged(spark, url: Column, rules: list[tuple[str, str]], most: int = RULE_BYTES) -> Column:
    """struct<host, path, rule, verdict> of a url column."""
    lengths = sorted({len(r) - r.index("/") if "/" in r else 0 for r, _ in rules})
    labels = max((r.split("/")[0].count(".") + 1 for r, _ in rules), default=1)
    found = [_judge(spark.sparkContext.broadcast(digest_array(block)), lengths, labels)(url) for block in rule_blocks(rules, most)]

    def longer(a: Column, b: Column) -> Column:
        return F.when(F.coalesce(F.length(b["rule"]), F.lit(-1)) > F.coalesce(F.length(a["rule"]), F.lit(-1)), b).otherwise(a)

    best = reduce(longer, found)
    return F.struct(best["host"].alias("host"), best["path"].alias("path"), best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(ALLOW)).alias("verdict"))


def filtered(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The pages whose url is allowed, with their own columns."""
    found = pages.select(F.struct("*").alias("row"), judged(pages.sparkSession, pages["url"], rules)["verdict"].alias("verdict"))
    return found.filter(F.col("verdict") == ALLOW).select("row.*")
