"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is described by the
histogram of pairs of neighbouring character classes, word statistics and hashed words, and
encoded by a learned layer. Gated attention (tanh times sigmoid) weighs the encoded
passages of a document, and the document's label alone trains encoder, attention and output
together. The score is the sigmoid of the output on the attention-weighted mean.

The classifier is fitted on a bounded sample of labelled training documents: those first by hash of
their ids, about ``SAMPLE`` of them and, taken in that order, of ``SAMPLE_BYTES`` bytes of text
in all. Their whole texts are encoded; every passage of every document is scored.

Defined cases: a null or wordless text is one empty passage; texts of any length are scored whole, and
repeated rows and rows without doc_id like others; an empty table gives no rows; labels that are null are not
used; a document with two different labels counts once for each, and of rows that share a
doc_id one is learned from; without labels, or with one class
only, the score is the share of label 1 (0.5 without labels). Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm._shared import small_batches, staged

PASSAGE = 64
SAMPLE = 4000
#: Bytes of text in the sample; a labelled document that alone has more is scored, but not learned from.
SAMPLE_BYTES = 64_000_000
HIDDEN, ATTENTION = 24, 12
EPOCHS, RATE, DECAY = 30, 0.01, 1e-4
HASHED = 32
#: Words of a text that are described at a time.
SPAN = 64_000
THRESHOLD = 0.3

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",;:", "!?", "'\"-", "()[]{}<>", "|/\\", "#$%&*+=@^_`~")
N_CLASSES = len(_CLASSES) + 1
CLASS_OF = np.full(256, N_CLASSES - 1, np.int64)  # the last class: bytes beyond ASCII and control characters
for _i, _letters in enumerate(_CLASSES):
    CLASS_OF[list(_letters.encode())] = _i
FEATURES = N_CLASSES * N_CLASSES + HASHED + 4


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage."""
    words = text.encode().split() if text else []
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    return np.concatenate([_described(words[i : i + SPAN], PASSAGE) for i in range(0, len(words), SPAN)])


def _described(words: list[bytes], size: int) -> np.ndarray:
    n = -(-len(words) // size)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    passage = np.arange(len(words)) // size
    letters = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    of_letter = np.repeat(passage, lengths + 1)
    classes = CLASS_OF[letters]
    pair = of_letter[1:] * N_CLASSES**2 + classes[:-1] * N_CLASSES + classes[1:]
    counts = np.bincount(pair, minlength=n * N_CLASSES**2).reshape(n, -1).astype(np.float32)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    hashes = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words))
    bag = np.bincount(passage * HASHED + hashes % HASHED, minlength=n * HASHED).reshape(n, -1).astype(np.float32)
    in_passage = np.bincount(passage, minlength=n).astype(np.float32)
    again = np.r_[False, hashes[1:] == hashes[:-1]]
    distinct = np.unique(passage * (1 << 32) + hashes) >> 32
    stats = np.stack(
        [
            np.bincount(distinct, minlength=n) / in_passage,
            np.bincount(passage, weights=again, minlength=n) / in_passage,
            np.bincount(passage, weights=lengths, minlength=n) / in_passage / 10,
            in_passage / size,
        ],
        axis=1,
    ).astype(np.float32)
    return np.concatenate([np.sqrt(shares), bag / in_passage[:, None], stats], axis=1)


class Network:
    """Encoder, gated attention and output. ``starts`` are the first rows of the bags."""

    def __init__(self, features: int, seed: int = 7):
        rng = np.random.default_rng(seed)

        def draw(a, b):
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.w = {"encode": draw(features, HIDDEN), "encode_b": np.zeros(HIDDEN), "tanh": draw(HIDDEN, ATTENTION), "gate": draw(HIDDEN, ATTENTION), "weigh": draw(ATTENTION, 1), "out": draw(HIDDEN, 1), "out_b": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        w, s = self.w, {}
        bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        s["x"], s["bag"] = (x - self.mean) / self.scale, bag
        s["h"] = np.tanh(s["x"] @ w["encode"] + w["encode_b"])
        s["t"], s["g"] = np.tanh(s["h"] @ w["tanh"]), _sigmoid(s["h"] @ w["gate"])
        e = ((s["t"] * s["g"]) @ w["weigh"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        s["a"] = e / np.add.reduceat(e, starts)[bag]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], starts, axis=0)
        s["p"] = _sigmoid((s["z"] @ w["out"])[:, 0] + w["out_b"][0])
        return s

    def gradients(self, s: dict, y: np.ndarray, starts: np.ndarray) -> dict:
        w, bag = self.w, s["bag"]
        d = ((s["p"] - y) / len(y))[:, None]
        g = {"out": s["z"].T @ d, "out_b": d.sum(axis=0)}
        dz = (d @ w["out"].T)[bag]
        da = (dz * s["h"]).sum(axis=1)
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, starts)[bag])
        g["weigh"] = (s["t"] * s["g"]).T @ de[:, None]
        du = de[:, None] * w["weigh"].T
        dt, dg = du * s["g"] * (1 - s["t"] ** 2), du * s["t"] * s["g"] * (1 - s["g"])
        g["tanh"], g["gate"] = s["h"].T @ dt, s["h"].T @ dg
        dh = (s["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - s["h"] ** 2)
        g["encode"], g["encode_b"] = s["x"].T @ dh, dh.sum(axis=0)
        return g

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, seed: int = 7) -> None:
        rows = np.concatenate(bags)
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-2
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), batch):
                chosen = order[at : at + batch]
                sizes = [len(bags[i]) for i in chosen]
                starts = np.cumsum([0, *sizes[:-1]])
                s = self.forward(np.concatenate([bags[i] for i in chosen]), starts)
                step += 1
                for k, g in self.gradients(s, labels[chosen], starts).items():
                    g = g + DECAY * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return self.forward(np.concatenate(bags), np.cumsum([0, *(len(b) for b in bags[:-1])]))["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Constant:
    """Where there is nothing to learn from."""

    def __init__(self, p: float):
        self.p = p

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.full(len(bags), self.p)


def sampled_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Distinct doc_id and label (0 or 1) of about ``sample`` labelled documents, by hash of the doc_id."""
    usable = labels.filter("label is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("label").cast("int")).distinct()
    share = min(1.0, sample / max(1, usable.count()))
    return usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def _within_bytes(sizes: list, most: int) -> set[int]:
    """The doc_ids, by hash, whose texts fit into ``most`` bytes together."""
    taken, total = set(), 0
    for doc_id, size in sorted(sizes, key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[0])):
        if total + size <= most:
            taken.add(doc_id)
            total += size
    return taken


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | Constant:
    """Fits on the documents whose doc_id is in labels (doc_id, label)."""
    spark = docs.sparkSession
    chosen = staged(sampled_labels(labels, sample).withColumnRenamed("doc_id", "labelled"), "labels")  # about ``sample`` rows
    small_batches(spark)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    sizes = narrow.join(F.broadcast(chosen), narrow["doc_id"] == chosen["labelled"]).groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    taken = spark.createDataFrame([(i,) for i in _within_bytes(sizes.collect(), sample_bytes)], "labelled long")
    chosen = F.broadcast(chosen.join(F.broadcast(taken), "labelled", "left_semi"))
    texts = narrow.join(chosen, narrow["doc_id"] == chosen["labelled"]).select("doc_id", "label", "text")
    encoded = texts.mapInArrow(_encoded, "doc_id long, label int, features binary")
    rows = encoded.groupBy("doc_id", "label").agg(F.min("features").alias("features")).toPandas().sort_values(["doc_id", "label"], ignore_index=True)
    y = rows["label"].to_numpy(float)
    if not len(y) or len(set(y)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    network = Network(FEATURES)
    network.fit([np.frombuffer(f, np.float16).reshape(-1, FEATURES).astype(np.float32) for f in rows["features"]], y)
    return network


def _encoded(batches):
    for batch in batches:
        data = [passages(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(data, pa.binary())], ["doc_id", "label", "features"])


def scorer(spark, model):
    """Column function: text -> score."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out, bags, size = [], [], 0
            for text in texts:
                bags.append(passages(text.as_py()))
                size += len(bags[-1])
                if size > 20_000:
                    out.append(sent.value.score(bags))
                    bags, size = [], 0
            if bags:
                out.append(sent.value.score(bags))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score
