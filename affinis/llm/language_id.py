"""Language identification by word-first backoff.

Training counts every word of every labelled training text by language, and from the words every
character n-gram of orders 5, 4, ..., 1 (with edge marks). Both tables are whole: nothing is cut
off, they grow with the corpus and stay in the shared folder as tables.

A known word scores its log frequency in each language. An unseen word falls back to its
5-grams; if none is known, to its 4-grams, and so on down to single characters, and scores the
mean of the known ones. The mean score over a text's words gives one number per language, and
their softmax at ``SHARPNESS`` the score of the best.

Words that make up more than one in ``HOT_WORDS`` of all training words, of which there are fewer
than HOT_WORDS at any size, are sent to the tasks, which add up their scores while they read the
texts. Only the other words of a text leave it: each distinct one is scored once by joins
with the tables, and the scores are joined back to the texts that hold it, those of words that
many texts share map-side. Which way a word takes never changes a result.

Defined cases: a null text and a text without a letter are ``und`` with score 0; a text of
letters of which nothing is known gets the language with the most training words and the
score one over the number of languages; ties go to the language that sorts first. With no
labelled text every text is ``und``. Texts of any length are read whole; repeated rows and rows
without doc_id are predicted like others. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm._shared import HOT_SHARE, join_hot, keep_rows, small_batches, staged, text_key

HOT_WORDS = 1_000_000
ORDERS = (5, 4, 3, 2, 1)
SHARPNESS = 4.0
DIGITS = 9
UNKNOWN = "und"
#: Distinct words a task counts before it passes its counts on, and letters of words whose n-grams it counts at a time.
COUNTED = 200_000
LETTERS = 1_000_000
#: Distinct words per task where n-grams are made.
WORDS_A_TASK = 50_000
WORD = regex.compile(r"\p{L}+")
#: Bytes of Latin-1: letters in lower case, and blanks for all else.
LATIN = bytes(ord(chr(b).lower()) if unicodedata.category(chr(b))[0] == "L" else 32 for b in range(256))


def words(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _count_words(batches):
    counts: dict[str, Counter] = {}
    held = 0

    def rows():
        for lang, c in counts.items():
            entries = list(c.items())
            for at in range(0, len(entries), 50_000):
                part = entries[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            c = counts.setdefault(lang.as_py(), Counter())
            before = len(c)
            c.update(words(text.as_py()))
            held += len(c) - before
        if held > COUNTED:
            yield from rows()
            counts, held = {}, 0
    yield from rows()


def _by_language(langs: list[str], n: Column) -> Column:
    """Sums of n as an array, one for each language."""
    zero = F.lit(0).cast("long")
    return F.array(*[F.sum(F.when(F.col("lang") == lang, n).otherwise(zero)) for lang in langs]).alias("n")


def word_counts(training: DataFrame, langs: list[str]) -> DataFrame:
    """word and n (an array by language) over all training texts (columns text, lang)."""
    small_batches(training.sparkSession)
    labelled = training.select(training["text"].alias("text"), training["lang"].alias("lang")).filter("text is not null and lang is not null")
    return labelled.mapInArrow(_count_words, "lang string, word string, n long").groupBy("word").agg(_by_language(langs, F.col("n")))


def _gram_counts(some: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of words with counts n (words x languages).

    An n-gram is numbered by that of its first n - 1 letters and its last letter, so numbers stay small and exact."""
    text = "".join([f"<{w}>" for w in some])
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(some)), np.fromiter(map(len, some), np.int64, len(some)) + 2)
    alphabet, code = np.unique(letters, return_inverse=True)
    number = code.astype(np.int64)
    for order in sorted(ORDERS):
        if order == 1:
            at = np.flatnonzero((letters != ord("<")) & (letters != ord(">")))
            key = number[at]
        else:
            at = np.flatnonzero(owner[: len(owner) - order + 1] == owner[order - 1 :])
            key = number[at] * len(alphabet) + code[at + order - 1]
        if not len(at):
            continue
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if order > 1:
            number = np.zeros(len(letters), np.int64)
            number[at] = inverse
        sums = np.stack([np.bincount(inverse, weights=n[owner[at], k], minlength=len(first)) for k in range(n.shape[1])], axis=1).astype(np.int64)
        found = pa.array([text[i : i + order] for i in at[first].tolist()], pa.string())
        counts = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), n.shape[1]).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), order), pa.int32()), found, counts], ["ord", "gram", "n"])


def _gram_rows(languages: int):
    def run(batches):
        some, counts, held = [], [], 0
        for batch in batches:
            some += batch.column("word").to_pylist()
            counts.append(batch.column("n").flatten().to_numpy())
            held += sum(map(len, some[len(some) - batch.num_rows :]))
            if held >= LETTERS:
                yield from _gram_counts(some, np.concatenate(counts).reshape(-1, languages))
                some, counts, held = [], [], 0
        if some:
            yield from _gram_counts(some, np.concatenate(counts).reshape(-1, languages))

    return run


@dataclass
class Model:
    """The languages, their sums of counts by order (0: words), the number of entries by order, and
    the tables ``words`` (word, n) and ``grams`` (ord, gram, n), with n by language. ``hot`` are the
    words that are sent to the tasks, with their scores."""

    langs: list[str]
    totals: dict[int, np.ndarray]
    sizes: dict[int, int]
    words: DataFrame | None
    grams: DataFrame | None
    hot: tuple[dict[str, int], np.ndarray]

    def denominators(self, order: int) -> np.ndarray:
        """What a language does not have counts a half, and so does what no language has."""
        return self.totals[order] + 0.5 * (self.sizes[order] + 1)

    def logs(self, order: int) -> Column:
        """The scores by language of a row's counts n."""
        below = F.array(*[F.lit(float(d)) for d in self.denominators(order)])
        return F.zip_with("n", below, lambda n, d: F.log((n + 0.5) / d))


def fit(training: DataFrame, hot_words: int = HOT_WORDS) -> Model:
    """Counts over all of ``training`` (text, lang)."""
    langs = sorted(r.lang for r in training.filter("text is not null").select("lang").distinct().collect() if r.lang is not None)
    if not langs:
        return Model([], {}, {}, None, None, ({}, np.zeros((0, 0))))
    known = staged(word_counts(training, langs), "word_counts")
    sums = [F.sum(F.col("n")[i]).alias(f"s{i}") for i in range(len(langs))]
    row = known.agg(F.count("*").alias("size"), *sums).first()
    totals, sizes = {0: _totals(row, langs)}, {0: row["size"]}
    dealt = known.repartition(max(1, -(-row["size"] // WORDS_A_TASK)))
    counted = dealt.mapInArrow(_gram_rows(len(langs)), "ord int, gram string, n array<long>")
    grams_ = counted.groupBy("ord", "gram").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(len(langs))]).alias("n"))
    grams_ = staged(grams_, "gram_counts")
    found = {r["ord"]: r for r in grams_.groupBy("ord").agg(F.count("*").alias("size"), *sums).collect()}
    for order in ORDERS:
        totals[order] = _totals(found.get(order), langs)
        sizes[order] = found[order]["size"] if order in found else 0
    model = Model(langs, totals, sizes, known, grams_, ({}, np.zeros((0, len(langs)))))
    every = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    # more than a share of all words: fewer than hot_words rows, whatever the size
    rows = known.filter(every * hot_words > int(totals[0].sum())).collect()
    n = np.array([r["n"] for r in rows], float).reshape(len(rows), len(langs))
    model.hot = ({r["word"]: i for i, r in enumerate(rows)}, np.log((n + 0.5) / model.denominators(0)))
    return model


def _totals(row, langs: list[str]) -> np.ndarray:
    return np.array([(row[f"s{i}"] or 0) if row else 0 for i in range(len(langs))], float)


def _hot_scores(sent, languages: int):
    """Sums over a text's hot words, and its other words with their counts."""

    def run(batches):
        index, logs = sent.value
        for batch in batches:
            totals, sizes, some, rest, times = [], [], [], [], []
            for text in batch.column("text"):
                counts = Counter(words(text.as_py()))
                hot = [w for w in counts if w in index]
                n = np.fromiter((counts.pop(w) for w in hot), np.int64, len(hot))
                totals.append(n @ logs[[index[w] for w in hot]] if hot else np.zeros(languages))
                sizes.append(int(n.sum()))
                some.append(bool(hot or counts))
                rest.append(list(counts))
                times.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(totals, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(some, pa.bool_()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "total", "n", "some", "rest", "times"],
            )

    return run


def _word_grams(order: int):
    """id of a word, n-gram and how often it has it."""

    def rows(entries):
        ids, found, times = zip(*entries, strict=True) if entries else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(times, pa.int64())], ["id", "gram", "times"])

    def run(batches):
        for batch in batches:
            entries = []
            for i, w in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                entries += [(i, g, n) for g, n in Counter(grams(w, order)).items()]
                if len(entries) > COUNTED:
                    yield rows(entries)
                    entries = []
            yield rows(entries)

    return run


def word_scores(asked: DataFrame, model: Model) -> DataFrame:
    """word and s (scores by language) of those distinct words (column word) of which something is known."""
    number = F.monotonically_increasing_id().alias("id")  # stands for the word, which may be long
    known = asked.select("word").join(model.words, "word", "left")
    looked_up = staged(known.select("word", number, F.when(F.col("n").isNotNull(), model.logs(0)).alias("s")), "word_scores")
    found, left = [looked_up.filter("s is not null")], looked_up.filter("s is null").select("word", "id")
    for order in ORDERS:
        rows = left.count()
        if not rows:
            break
        each = left.repartition(max(1, -(-rows // WORDS_A_TASK))).mapInArrow(_word_grams(order), "id long, gram string, times long")
        tables = model.grams.filter(F.col("ord") == order).select("gram", model.logs(order).alias("s"))
        mean = F.array(*[F.sum(F.col("times") * F.col("s")[i]) / F.sum("times") for i in range(len(model.langs))]).alias("s")
        hits = each.join(tables, "gram").groupBy("id").agg(mean)
        step = staged(left.join(hits, "id", "left"), "word_scores")
        found.append(step.filter("s is not null"))
        left = step.filter("s is null").select("word", "id")
    return reduce(DataFrame.unionByName, [f.select("word", "s") for f in found])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, text_key, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("text_key"), docs["text"].alias("text"))
    if not model.langs:
        return narrow.select("doc_id", "text_key", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    languages = range(len(model.langs))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text_key long, total array<double>, n long, some boolean, rest array<string>, times array<long>"
    first = narrow.mapInArrow(_hot_scores(spark.sparkContext.broadcast(model.hot), len(model.langs)), schema)
    first = staged(first.withColumn("row_id", F.monotonically_increasing_id()), "hot_scores")
    rest = first.select("row_id", F.explode(F.arrays_zip("rest", "times")).alias("z")).select("row_id", F.col("z.rest").alias("word"), F.col("z.times").alias("n"))
    asked = staged(rest.groupBy("word").agg(F.count("*").alias("texts")), "asked")
    side = staged(asked.join(word_scores(asked, model), "word"), "sides")
    total = asked.agg(F.sum("texts")).first()[0] or 0
    hot = side.filter(F.col("texts") * HOT_SHARE > total).drop("texts")
    joined = join_hot(rest, side.drop("texts"), hot, "word")
    added = joined.groupBy("row_id").agg(F.sum("n").alias("m"), *[F.sum(F.col("n") * F.col("s")[i]).alias(f"a{i}") for i in languages])
    both = first.select("doc_id", "text_key", "row_id", "total", "n", "some").join(added, "row_id", "left")
    n = F.col("n") + F.coalesce("m", F.lit(0))
    # rounded, as the sums depend on the order of rows in their last digits
    mean = F.array(*[F.round((F.col("total")[i] + F.coalesce(f"a{i}", F.lit(0.0))) / n * SHARPNESS, DIGITS) for i in languages])
    both = both.select("doc_id", "text_key", "some", F.when(n > 0, mean).alias("mean"))
    most = F.array_max("mean")
    odds = F.aggregate("mean", F.lit(0.0), lambda a, x: a + F.exp(x - most))
    commonest = model.langs[int(np.argmax(model.totals[0]))]
    best = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("mean", most).cast("int"))
    return both.select(
        "doc_id", "text_key", F.when(~F.col("some"), UNKNOWN).when(F.col("mean").isNull(), commonest).otherwise(best).alias("lang_pred"),
        F.when(~F.col("some"), 0.0).when(F.col("mean").isNull(), 1 / len(model.langs)).otherwise(1 / odds).alias("score"),
    )


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def accepted(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """The documents in a language of the model, with their own columns."""
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
    return keep_rows(docs, staged(predicted(docs, model).select("doc_id", "text_key", kept.alias("kept")), "decided"))
