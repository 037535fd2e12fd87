"""The training-data operators against brute force, on hard inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from affinis.llm import chat_format, decontaminate, exact_dedup, language_id, packing, quality, queries, secret_scan, sharding, simhash, url_filter

#: Columns whose names operators use within, to clash with them.
CLASH = ["size", "shard", "slot", "fp", "digest", "row", "score", "text_key", "kept", "rank", "row_id", "component_id", "matches", "n_words"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def docs(spark, rows):
    """rows: (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, *["x"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
HARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Hello  World again and again"), (6, "hello world again AND again"), (7, LONG), (7, LONG), (None, "no id here at all"), (8, "é" * 5), (9, "Hello World\nagain and again")]


# 1 Sharding


def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(30):
        m, n = rng.randrange(1, 4), rng.randrange(1, 4)
        supply = np.array([rng.randrange(5) for _ in range(m)])
        capacity = sharding.equal_capacities(int(supply.sum()), n)
        cost = np.array([[float(j != i % n) for j in range(n)] for i in range(m)])
        flow = sharding.min_cost_flow(supply, capacity, cost)
        assert (flow.sum(axis=1) == supply).all() and (flow.sum(axis=0) <= capacity).all() and (flow >= 0).all()
        best = min(
            sum(cost[i, j] for i, js in enumerate(pick) for j in js)
            for pick in itertools.product(*[itertools.combinations_with_replacement(range(n), int(s)) for s in supply])
            if all(sum(js.count(j) for js in pick) <= capacity[j] for j in range(n))
        )
        assert (flow * cost).sum() == best


def test_many_files_are_one_flow():
    """The merged flow costs what the whole one does, blocks come within one block of it, and few files lose one."""
    rng = np.random.default_rng(3)
    for n_old, n_new in ((1, 8), (5, 3), (40, 4), (3, 8)):
        supply = rng.integers(0, 50, n_old)
        home = np.arange(n_old) % n_new
        capacity = sharding.equal_capacities(int(supply.sum()), n_new)
        cost = (np.arange(n_new)[None, :] != home[:, None]).astype(float)
        whole = (sharding.min_cost_flow(supply, capacity, cost) * cost).sum()
        merged, here = np.bincount(home, weights=supply, minlength=n_new), np.arange(n_new)
        far = (here[None, :] != here[:, None]).astype(float)
        assert (sharding.min_cost_flow(merged, capacity, far) * far).sum() == whole
        old = np.repeat(np.arange(n_old), supply)  # blocks of a byte meet the flow exactly
        shard = sharding.assign_blocks(old, np.ones(len(old), np.int64), home, capacity)
        assert (shard != home[old]).sum() == whole and (np.bincount(shard, minlength=n_new) == capacity).all()
    old = np.repeat(np.arange(100_000), 2)
    size = rng.integers(1, 10_000, len(old))
    capacity = sharding.equal_capacities(int(size.sum()), 8)
    shard = sharding.assign_blocks(old, size, np.arange(100_000) % 8, capacity)
    sizes = np.bincount(shard, weights=size, minlength=8)
    assert sizes.max() - sizes.min() <= size.max()


def test_reshard_joins_a_long_block_map(spark, tmp_path, monkeypatch):
    """The block map beyond MAP_ROWS is not broadcast; results are the same."""
    docs(spark, HARD + [(100 + i, "t" * i) for i in range(50)]).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    def rows():
        return sorted((r.doc_id or -1, r.size, r.shard, r.slot) for r in queries.op1_sharding(spark, str(tmp_path)).collect())

    sent = rows()
    monkeypatch.setattr(sharding, "MAP_ROWS", 0)
    assert rows() == sent and sorted({r[2] for r in sent}) == list(range(8))


def test_reshard_moves_little_and_keeps_rows(spark, tmp_path):
    rows = [(i, "t" * (i % 50)) for i in range(400)]
    for k in range(4):
        docs(spark, rows[k * 100 : (k + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    plan = sharding.plan(spark, str(tmp_path / "documents.parquet"), 4)
    assert plan.bytes_moved <= 0.02 * plan.total  # the files are alike in size already
    out = sharding.reshard(spark, str(tmp_path / "documents.parquet"), 8).select("row.doc_id", "row.text", "row.shard", F.col("shard").alias("new"), "slot").collect()
    assert sorted(r.doc_id for r in out) == list(range(400)) and {r.shard for r in out} == {"x"}
    assert all(r.text == "t" * (r.doc_id % 50) for r in out)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r.new].append(r.slot)
        sizes[r.new] += len(r.text) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(sizes.values()) - min(sizes.values()) <= 2


def test_reshard_hard_rows_and_none(spark, tmp_path):
    docs(spark, HARD).write.parquet(str(tmp_path / "a/documents.parquet"))
    got = queries.op1_sharding(spark, str(tmp_path / "a")).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in HARD)
    docs(spark, []).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert queries.op1_sharding(spark, str(tmp_path / "b")).count() == 0


# 2 SimHash


def brute_print(text):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(prints))]


def test_fingerprints(spark):
    got = sorted((r.doc_id or -1, r.fp % 2**64) for r in simhash.fingerprints(docs(spark, HARD)).collect())
    assert got == sorted((i or -1, brute_print(t)) for i, t in HARD)


def test_pivot_table_is_stored():
    prints = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 50)
    import pyarrow as pa

    [batch] = simhash._coordinates([pa.RecordBatch.from_arrays([pa.array(prints)], ["fp"])])
    got = simhash._unpacked([batch.column(c).to_numpy() for c in simhash.COORDINATES])
    assert (got == simhash.pivot_table(prints.view(np.uint64), simhash.reference_fingerprints())).all()
    assert got[3, 5] == bin(int(prints[3]) % 2**64 ^ int(simhash.reference_fingerprints()[5])).count("1")
    assert [simhash.blocks_for(n) for n in (0, 10_000, 10**6, 10**8, 10**10)] == [5, 5, 6, 7, 8]


@pytest.mark.parametrize(("chunk", "blocks"), [(5, 7), (2048, 7), (5, 5), (2048, 6)])
def test_links_lose_no_component(spark, chunk, blocks):
    """A dense ball, chains and strangers, with keys that hold more than one chunk."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(60)] + [rng.getrandbits(64) for _ in range(40)]
    for _ in range(20):
        prints.append(prints[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    found = simhash.components(simhash.links(simhash.with_coordinates(frame), blocks=blocks, chunk=chunk)).collect()
    label = {r.node: r.root for r in found}
    ids = [x - 2**64 if x >> 63 else x for x in prints]
    assert [label.get(i, i) for i in ids] == brute_components(prints, ids)


def test_groups_of_hard_rows(spark):
    got = simhash.groups(docs(spark, HARD)).collect()
    assert len(got) == len(HARD) and sum(r.kept for r in got) == len({r.component_id for r in got})
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.dedup(docs(spark, HARD))
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id or -1 for r in kept.collect()).count(7) == 1
    assert simhash.groups(docs(spark, [])).count() == 0


# 3 Quality


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]

    def text(good):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 300))]
        return " ".join(w) if good else " ".join(f"{x}%%%" for x in w)

    rows = [(i, text(i % 3 > 0)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, label int")
    model = quality.fit(docs(spark, rows), labels)
    got = docs(spark, rows + HARD).select("doc_id", "text", quality.scorer(spark, model)(F.col("text")).alias("p")).collect()
    assert len(got) == len(rows) + len(HARD) and all(0 <= r.p <= 1 for r in got)
    unseen = [r for r in got if r.text and r.doc_id and 200 <= r.doc_id < 240]
    assert np.mean([(r.p >= 0.5) == (r.doc_id % 3 > 0) for r in unseen]) > 0.95
    none = quality.fit(docs(spark, rows), labels.limit(0))
    assert none.score([np.zeros((1, quality.FEATURES))]).tolist() == [0.5]


def test_quality_sample_is_bounded_in_bytes(spark):
    assert quality._within_bytes([(1, 60), (2, 50), (3, 30), (4, 500), (5, 0)], 100) in ({1, 3, 5}, {2, 3, 5}) and quality._within_bytes([], 5) == set()
    rows = [(i, "good words here " * 3 if i % 2 else "%% " * 9) for i in range(40)] + [(99, "%% " * 100_000)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in [*range(40), 99]], "doc_id long, label int")
    model = quality.fit(docs(spark, rows), labels, sample_bytes=10_000)  # without the long one
    got = docs(spark, rows).select("doc_id", quality.scorer(spark, model)(F.col("text")).alias("p")).collect()
    assert len(got) == 41 and all((r.p >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id < 40)
    assert docs(spark, []).select(quality.scorer(spark, model)(F.col("text")).alias("p")).count() == 0


def test_quality_query(spark, tmp_path, sf):
    """Columns follow from the model's scores of whole texts; documents that no training label names are scored too."""
    source, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in source.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    training = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(source, training)
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf).collect()}
    assert got.keys() == texts.keys() and all(got[i].held_out == held[i] for i in texts)
    for i, t in texts.items():
        assert got[i].score == pytest.approx(float(model.score([quality.passages(t)])[0]), abs=1e-6) and got[i].predicted == int(got[i].score >= 0.3) and 0 <= got[i].score <= 1


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network(6)
    x, starts, y = rng.normal(size=(7, 6)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.forward(x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(net.forward(x, starts), y, starts)
    for name, w in net.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


# 4 URL filter


def test_urls(spark):
    urls = [None, "", "no scheme", "http://net", "http://a.net/x", "http://EXAMPLE.net/en/1?q", "http://sub.example.net/de", "http://example.com/de/", "http://badexample.com/de/", "https://x.org/fr/?a#b", "http://x.org#/fr/", "ftp://h:80/p/q?r", "a://net/://org/fr/"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.j.host, r.j.path, r.j.rule, r.j.verdict) for r in rows.select("page_id", url_filter.judged(spark, rows["url"], queries.URL_RULES).alias("j")).collect()}

    def brute(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for r, v in queries.URL_RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if m and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    split = {r.page_id: r.v for r in rows.select("page_id", url_filter.judged(spark, rows["url"], queries.URL_RULES, most=12)["verdict"].alias("v")).collect()}
    assert split == {i: v[3] for i, v in got.items()}


def test_urls_long_repeated_and_none(spark):
    long = "http://" + "a." * 20_000 + "example.com/de/" + "p" * 50_000
    rows = spark.createDataFrame([(1, long), (1, long), (2, "http://net/x")], "page_id long, url string")
    got = rows.select("page_id", url_filter.judged(spark, rows["url"], queries.URL_RULES).alias("j")).collect()
    assert sorted((r.page_id, r.j.rule, r.j.verdict) for r in got) == [(1, "example.com/de/", "block")] * 2 + [(2, "net/", "block")]
    assert len(url_filter.probes_of("a." * 20_000 + "b", "/x/", [0, 1], 2)) == 4
    assert url_filter.probes_of("a.b.c", "/x/", [1], 3) == ["a.b.c/", "b.c/", "c/"] and url_filter.probes_of("a.b.c", "/x/", [1], 2) == ["b.c/", "c/"]
    empty = rows.limit(0)
    assert empty.select(url_filter.judged(spark, empty["url"], queries.URL_RULES).alias("j")).count() == 0 and url_filter.filtered(rows, queries.URL_RULES).count() == 0


def test_colliding_keys_do_not_match(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))
    found = url_filter.DigestArray(url_filter.digest_array([("aa/", "block"), ("bb/", "allow"), ("aa/", "allow")]))
    assert found.find([b"bb/", b"cc/", b"aa/"]).tolist() == [1, -1, 0] and found.blocked.tolist() == [1, 0]
    assert url_filter.DigestArray(url_filter.digest_array([])).find([b"x"]).tolist() == [-1]


# 5 Packing


def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    slow, fast = Tokenizer.from_file(path), packing.encoder(path)
    texts = ["", " ", "Hello  world\n\n\tx", "naïve café 中文 😀", "a<|endoftext|> b", "it's 1234 !!", "x" * 3000, "\u00a0\u3000\x1c z"]
    rng = random.Random(55)
    alphabet = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x85", "7", "12", "٣", "Ⅷ", "a", "Ab", "é", "e\u0301", "\u0301", "ß", "中", "न", "😀", "👩‍💻", "'s", "'", "!", "--", "_", "<|endoftext|>", "<|", "\ufffd", "\u200b"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" " * 1_000_000 + "a", "x" + "\n " * 100_000 + "b <|endoftext|> c", "a" * 200_000, "!" * 100_000]
    for t in texts:
        assert list(fast(t)) == slow.encode(t, add_special_tokens=False).ids, t[:200]


def test_packed_pieces_are_whole(spark):
    from tokenizers import Tokenizer

    rows = HARD + [(100 + i, "word " * (i * 37 % 900)) for i in range(120)] + [(300, " " * 1_000_000 + "a")]
    got = packing.placements(packing.tokenised(docs(spark, rows), queries.tokenizer_path())).collect()
    slow, by_row, by_sequence = Tokenizer.from_file(queries.tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r.row_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_row) == len(rows)
    left = [slow.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.piece)
        total = sum(r.length for r in pieces)
        match = next(ids for ids in left if len(ids) == total and all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in pieces))
        left.remove(match)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]])) and all(r.length == 2048 for r in pieces[1:])
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s[:-1]])) and sum(r.length for r in s) <= 2048
    assert packing.placements(packing.tokenised(docs(spark, []), queries.tokenizer_path())).count() == 0


def test_local_search_raises_squares_and_empties_bins():
    bins = packing.Bins(10)
    for i, sizes in enumerate(([6, 3], [5, 4], [1, 1])):
        bins.bins.append([(s, (i, k)) for k, s in enumerate(sizes)])
        bins.free.append(10)
        bins.by_free[10].add(i)
        bins.place(i, 10 - sum(sizes))
    before = sum((10 - f) ** 2 for f in bins.free)
    assert packing.local_search(bins) > 0
    assert sum((10 - f) ** 2 for f in bins.free) > before and sum(bool(b) for b in bins.bins) == 2
    rng = random.Random(2)
    for _ in range(20):
        lengths = [rng.randrange(1, 2048) for _ in range(rng.randrange(1, 80))]
        packed = packing.pack(lengths)
        assert sorted(i for b in packed for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 2048 for b in packed)


def test_local_search_looks_at_all_open_bins():
    """The only exchange that helps is behind more than NEIGHBOURS fuller bins."""
    bins = packing.Bins(100)
    for i, sizes in enumerate([[99]] * 300 + [[60, 30], [45, 35]]):
        bins.bins.append([(s, (i, k)) for k, s in enumerate(sizes)])
        bins.free.append(100)
        bins.by_free[100].add(i)
        bins.place(i, 100 - sum(sizes))
    before = sum((100 - f) ** 2 for f in bins.free)
    assert packing.local_search(bins) > 0 and sum((100 - f) ** 2 for f in bins.free) > before
    assert sorted(x for b in bins.bins for _, x in b) == sorted([(i, 0) for i in range(302)] + [(300, 1), (301, 1)])


# 6 Exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    return sorted((rows[i][0] or -1, min(g)[2] if not min(g)[1] else -1, len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, i in g)


@pytest.mark.parametrize("copies", [0, 3000])
def test_exact_groups(spark, copies):
    """With many copies the digest is a heavy hitter, without it everything is shuffled."""
    rows = HARD + [(1000 + i, f"text number {i % 1500}") for i in range(2000)] + [(9000 + i, " same " * (1 + i % 3)) for i in range(copies)]
    got = exact_dedup.groups(docs(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id or -1, -1 if r.keep_id is None else r.keep_id, r.group_size, r.digest) for r in got) == brute_dedup(rows)
    assert sum(r.kept for r in got) == len({r.digest for r in got})


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    kept = exact_dedup.dedup(docs(spark, HARD))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 5, 6, 7, 8]  # the longest of each group
    assert exact_dedup.groups(docs(spark, [])).count() == 0


# 7 Secret scan


def test_secrets(spark):
    sha = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'the token = "{sha}" here'), (2, "call 4485123412341234 now"), (3, f"see commit {sha} and"), (4, None), (5, ""), (6, "plain words only"), (7, f"x {sha[:20]}Z a\n{sha} " * 3), (1, f'the token = "{sha}" here')]
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    got = secret_scan.scan(docs(spark, rows), model).collect()
    assert [(r.doc_id, r.is_secret) for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id < 4] == [(1, True), (1, True), (2, False), (3, False)]
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate for r in got)
    assert sorted(r.place for r in got if r.doc_id == 7) == [0, 1, 2, 3, 4, 5]
    assert secret_scan.scan(docs(spark, []), model).count() == 0


def test_assigned_secrets(spark):
    """Unquoted assignments without blanks, and short and digitless values of secret names."""
    sha, letters = hashlib.sha1(b"k").hexdigest(), "qWzKvXbTgHRmplJhTrEwQx"
    cases = [
        (f"token={sha}", sha, "token="), (f"GET /x?client_secret={sha}&y=1", sha, "client_secret="), (f"A=1\nAPI_KEY={sha}\nB=2", sha, "API_KEY="),
        (f"token={sha[:22]}==", sha[:22] + "==", "token="), (f"MY_SERVICE_API_KEY_2={sha}", sha, "MY_SERVICE_API_KEY_2="), ('password = "xK7pQ2vR9"', "xK7pQ2vR9", 'password = "'),
        (f"secret={letters}", letters, "secret="), (f"Authorization: Bearer {letters}", letters, "Bearer "), ("'pwd' => 'xK7$&;pQ2v'", "xK7$&;pQ2v", "'pwd' => '"),
        (f"DB postgres://bob:{letters[:9]}7@h/db", letters[:9] + "7", "://bob:"), (f"see eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.{letters} ok", f"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.{letters}", "see "),
        (f"token={sha}/key={sha}", sha, "/key="), ("user=abc123def456", "abc123def456", "user="),
    ]
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    rows = [(i, t) for i, (t, *_) in enumerate(cases)] + [(90, "The secret: nobody knows it."), (91, "token=${TOKEN} a=b"), (92, "=" * 20_000 + "a=" * 20_000 + " x")]
    got = defaultdict(list)
    for r in secret_scan.scan(docs(spark, rows), model).collect():
        got[r.doc_id].append(r)
        assert dict(rows)[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate
    for i, (_, value, before) in enumerate(cases):
        assert any(r.candidate == value and r.before.endswith(before) for r in got[i]), (i, got[i])
    secrets = {i for i, (_, value, _) in enumerate(cases) if any(r.candidate == value and r.is_secret for r in got[i])}
    assert secrets >= set(range(11)), {i: [(r.candidate, r.score) for r in rs] for i, rs in got.items()}
    assert not any(r.is_secret for r in got[90]) and not got[91]


def test_forest_tells_held_out_findings_apart(spark):
    """Findings of candidates that it was not fitted on, by precision and recall of each side."""
    every = secret_scan.labelled_findings(spark).withColumn("fold", F.pmod(F.xxhash64("candidate"), F.lit(4)))
    model = secret_scan.fit(every.filter("fold <> 0").drop("fold"))
    held = model.transform(secret_scan._described(every.filter("fold = 0"))).select("label", "prediction").collect()
    hit = sum(r.label == 1 and r.prediction == 1 for r in held)
    assert hit / sum(r.label == 1 for r in held) > 0.9 and hit / sum(r.prediction == 1 for r in held) > 0.9 and len(held) > 1000


# 8 Language


def brute_language(training, asked):
    """Prediction by plain counting."""
    counts = {o: defaultdict(lambda: defaultdict(int)) for o in (0, *language_id.ORDERS)}
    for _, text, lang in training:
        for w in regex.findall(r"\p{L}+", (text or "").lower()) if lang else ():
            counts[0][w][lang] += 1
            for o in language_id.ORDERS:
                for g in language_id.grams(w, o):
                    counts[o][g][lang] += 1
    langs = sorted({lang for _, t, lang in training if lang and t is not None})
    total = {(o, lang): sum(c[lang] for c in counts[o].values()) for o in counts for lang in langs}

    def score(o, g, lang):
        return math.log((counts[o][g].get(lang, 0) + 0.5) / (total[o, lang] + 0.5 * (len(counts[o]) + 1)))

    def one(text):
        found = regex.findall(r"\p{L}+", (text or "").lower())
        if not found:
            return "und", 0.0
        each = []
        for w in found:
            for o in (0, *language_id.ORDERS):
                known = [g for g in ([w] if o == 0 else language_id.grams(w, o)) if g in counts[o]]
                if known:
                    each.append([sum(score(o, g, lang) for g in known) / len(known) for lang in langs])
                    break
        if not each:
            return max(langs, key=lambda lang: (total[0, lang], -langs.index(lang))), 1 / len(langs)
        mean = [language_id.SHARPNESS * sum(e[i] for e in each) / len(each) for i in range(len(langs))]
        odds = [math.exp(m - max(mean)) for m in mean]
        return langs[odds.index(1.0)], 1 / sum(odds)

    return [one(t) for t in asked]


@pytest.mark.parametrize("hot_words", [1, 50, 1_000_000])
def test_language_equals_counting(spark, hot_words):
    """Whichever words are sent to the tasks."""
    rng = random.Random(8)
    vocabulary = {"aa": ["kava", "kavi", "Kavu", "kata", "ñu", "été"], "bb": ["mlen", "mlor", "mlun", "mrat", "б", "мла"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(20)), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]] + [(500, None, "aa"), (501, "x", None), (502, "no letter 1", "aa")]
    model = language_id.fit(docs(spark, rows), hot_words)
    assert len(model.hot[0]) < max(2, hot_words)
    asked = [(1, "kava kavi"), (2, "mlen mlor MLUN"), (3, None), (4, "123 !!"), (5, "kavakavi kavata"), (6, "ϖϖϖ"), (7, LONG), (7, LONG), (8, ""), (None, "mlen"), (9, "ÉTÉ ²½ µ ª ß ÿ кмла"), (10, "z" * 100_000), (11, "z m" * 50_000)]
    got = sorted((r.doc_id or -1, r.lang_pred, round(r.score, 8)) for r in language_id.predicted(docs(spark, asked), model).collect())
    assert got == sorted((i or -1, lang, round(p, 8)) for (i, _), (lang, p) in zip(asked, brute_language(rows, [t for _, t in asked]), strict=True))
    assert [lang for i, lang, _ in got if i in (1, 2, 3, 4, 5)] == ["aa", "bb", "und", "und", "aa"]
    kept = language_id.accepted(docs(spark, asked), model)
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 5, 6, 7, 7, 9, 10, 11]
    assert language_id.predicted(docs(spark, []), model).count() == 0 and language_id.accepted(docs(spark, []), model).count() == 0


def test_language_without_training(spark):
    nothing = language_id.fit(docs(spark, []))
    assert [tuple(r)[2:] for r in language_id.predicted(docs(spark, [(1, "word")]), nothing).collect()] == [("und", 0.0)]


def test_words_are_runs_of_letters():
    rng = random.Random(88)
    every = "".join(map(chr, range(256)))
    for t in [every, *["".join(rng.choice(every + "“’—żИ中") for _ in range(50)) for _ in range(500)]]:
        assert language_id.words(t) == regex.findall(r"\p{L}+", t.lower()), t


def test_language_query(spark, sf):
    """Against plain counting, whole; held-out documents are predicted well."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    want = brute_language([r for r in rows if not held[r[0]]], [t for _, t, _ in rows])
    got = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 8)) for r in queries.op8_language_id(spark, sf).collect())
    assert got == sorted((i, held[i], lang, round(p, 8)) for (i, *_), (lang, p) in zip(rows, want, strict=True))
    tested = [(lang, found) for (i, t, lang), (found, _) in zip(rows, want, strict=True) if held[i] and lang and found != "und"]
    assert np.mean([a == b for a, b in tested]) > 0.9


# 9 Chat formatting


def test_tool_calls(spark):
    def call(i, name, arguments, after="[]"):
        return f'{{"tool_calls":[{{"id":"{i}","name":"{name}","arguments":{arguments},"depends_on":{after}}}]}}'

    rows = [
        (1, 0, "system", "be brief"), (1, 1, "assistant", call("a", "add", '{"y": 2, "x": 1}', '["b"]')), (1, 2, "assistant", call("b", "add", '{"x": "no", "z": true}')), (1, 3, "tool", '{"tool_call_id":"b","content":"3"}'),
        (1, 4, "tool", '{"tool_call_id":"a","content":"4"}'), (1, 5, "tool", '{"tool_call_id":"q","content":"?"}'), (2, 0, "assistant", call("c", "add", "{}", '["d"]')), (2, 1, "assistant", call("d", "none", "[1]", '["c"]')),
        (2, 2, "tool", '{"tool_call_id":"c","content":""}'), (2, 3, "tool", '{"tool_call_id":"d","content":""}'), (3, 0, "user", None), (None, 1, "user", "hé \"q\""), (3, 1, "assistant", "{broken"), (3, 1, "assistant", "{broken"),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    schemas = [("add", "x", "integer", True), ("add", "y", "number", False), ("reply", "content", "string", True)]
    got = {(r.conv_id, r.turn, r.role): r for r in chat_format.formatted(frame, schemas).collect()}
    a, b = got[1, 1, "assistant"], got[1, 2, "assistant"]
    assert (a.status, b.status, got[1, 5, "tool"].status) == ("linked", "linked", "unasked") and a.errors == [] and b.errors == ["wrong type of x", "unknown z"]
    assert a.json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","role":"assistant"}'
    order = sorted(((r.effective_turn, r.hops, r.turn, r.call_id, r.kind) for r in got.values() if r.conv_id == 1 and r.call_id in ("a", "b")))
    assert [(c, k) for *_, c, k in order] == [("b", "call"), ("b", "result"), ("a", "call"), ("a", "result")]
    assert got[2, 0, "assistant"].cyclic and got[2, 1, "assistant"].errors == ["unknown tool"] and not a.cyclic
    assert got[3, 1, "assistant"].status == "repeated" and got[3, 0, "user"].status == "linked"
    assert got[None, 1, "user"].json == '{"arguments":{"content":"hé \\"q\\""},"id":"turn:2","name":"reply","role":"user"}'
    assert chat_format.formatted(frame.limit(0)).count() == 0


def test_turns_beside_tool_messages_are_plain(spark):
    """Conversation 1 has a tool call; its user's turn is no call of ``reply``, as those of 2 and of no conversation are."""
    call, result = '{"tool_calls":[{"id":"a","name":"add","arguments":{},"depends_on":[]}]}', '{"tool_call_id":"a","content":"3"}'
    rows = [(1, 0, "user", "what is it"), (1, 1, "assistant", call), (1, 2, "tool", result), (1, 3, "assistant", "it is 3"), (2, 0, "user", "hi"), (2, 1, "assistant", "x" * 2_000_000), (None, 0, "user", "hi"), (None, 1, "assistant", call)]
    got = {(r.conv_id, r.turn): (r.kind, r.status) for r in chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t] for t in range(4)] == [("message", None), ("call", "linked"), ("result", "linked"), ("message", None)]
    assert [got[2, t] for t in range(2)] == [("call", "linked"), ("result", "linked")] and got[None, 0] == ("call", "unanswered") and got[None, 1] == ("call", "unanswered")


# 10 Decontamination


def brute_hits(text, items, window):
    w = [x.decode() for x in decontaminate.words(text)]
    hit, found = set(), set()
    for i, t in items:
        v = [x.decode() for x in decontaminate.words(t)]
        for k in range(max(1, len(v) - window + 1)) if v else ():
            part = v[k : k + window]
            for s in range(len(w) - len(part) + 1):
                if w[s : s + len(part)] == part:
                    hit |= set(range(s, s + len(part)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("item_block", [2, 100])
def test_exact_phrases(spark, item_block, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 50)
    rng = random.Random(10)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(40)] + HARD + [(60, "A b C, a-b c!"), (61, "ä ö ü")]
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for k in range(6)] + [(7, None), (8, "..."), (None, "a b"), (9, "Ä ö"), (9, "ä Ö ü"), (2, "c c a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(decontaminate.matches(docs(spark, texts), bench, window=4, item_block=item_block)).collect()
    usable = [(i, t) for i, t in items if i is not None]
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i or -1, *brute_hits(t, usable, 4)) for i, t in texts)
    segments = decontaminate.index(docs(spark, texts))  # of all words, for any block of items
    vocabulary = sorted({w for _, t in texts for w in decontaminate.words(t)})
    assert decontaminate.term_counts(segments, vocabulary).sum() == sum(len(decontaminate.words(t)) for _, t in texts)
    assert decontaminate.term_counts(segments, [b"a", b"never"]).tolist() == [sum(decontaminate.words(t).count(b"a") for _, t in texts), 0]


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = [(1, "red x green y blue"), (2, "red x x x green blue"), (3, "red green blue"), (4, "blue green red")]
    got = {r.doc_id: [(m.start, m.end, m.kind) for m in r.matches] for r in decontaminate.matches(docs(spark, rows), bench, slop=2).collect()}
    assert got == {1: [(0, 5, "proximity")], 2: [], 3: [(0, 3, "exact")], 4: []}


def test_decontaminate_keeps_clean_documents(spark):
    bench = spark.createDataFrame([(1, "p q r")], "item_id long, text string")
    kept = decontaminate.decontaminate(docs(spark, [(1, "x p q r y"), (2, "x p q"), (3, None)]), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == docs(spark, []).columns
    assert decontaminate.matches(docs(spark, []), bench).count() == 0
    assert [r.n_hit for r in decontaminate.report(decontaminate.matches(docs(spark, [(1, "a")]), bench.limit(0))).collect()] == [0]


def test_items_without_an_id_are_hits(spark, tmp_path):
    bench = spark.createDataFrame([(None, "p q r"), (None, "u v"), (1, "q r s")], "item_id long, text string")
    rows = [(1, "x p q r s y"), (2, "u v"), (3, "clean"), (4, "q r s")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op10_decontaminate(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(queries.ORACLE_SQL["op10_decontaminate"]).fetchall())
    assert [(r[0], r[2], r[3]) for r in sorted(got)] == [(1, 4, 1), (2, 2, 0), (3, 0, 0), (4, 3, 1)]
    assert [r.doc_id for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()] == [3]


# Queries and the pipeline


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        path = Path(sf, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def rows(frame):
        return sorted(tuple("~" if x is None or x != x else str(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))

    assert rows(ours) == rows(theirs)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    source = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in source.collect()}
    docs_, kept = source, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = corpus_pipeline.staged(stage(spark, docs_, sf), name)
        assert docs_.columns == source.columns
        kept.append({r.doc_id for r in docs_.collect()})
    assert kept[0] == {i for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    exact = {k for k in kept[0] if k == min((j for j in kept[0] if re.sub(r"[\x20\x09-\x0D]", "", rows[j]) == re.sub(r"[\x20\x09-\x0D]", "", rows[k])), key=lambda j: (-len(rows[j]), j))}
    assert kept[1] == exact
    ids = sorted(exact)
    assert kept[2] == set(brute_components([brute_print(rows[i]) for i in ids], ids))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    phrases = {tuple(w[k : k + 10]) for _, t in items for w in [decontaminate.words(t)] for k in range(max(1, len(w) - 9))}
    dirty = {i for i in kept[2] for w in [decontaminate.words(rows[i])] for k in range(len(w)) if any(tuple(w[k : k + n]) in phrases for n in {len(p) for p in phrases})}
    assert kept[3] == kept[2] - dirty
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[3]
