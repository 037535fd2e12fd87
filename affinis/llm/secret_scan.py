"""Secret scan with a random forest against false positives, in DataFrame functions only.

Candidates are runs of 16 or more letters, digits and ``+/_=-`` with a digit among them, and
whatever is assigned to a name with a secret word in it, however short and without digits, the
password of ``scheme://user:password@host``, and a web token whole (parts between dots, the first
of which starts ``eyJ``). A run is split at its signs of assignment: ``name=`` belongs to the text before the value, while
``=`` at the end is padding and stays. Each candidate
is described by its length, its transitions between character classes, the share of it that
dictionary words cover, the path of its document, and the words on either side. A random
forest trained on labelled findings gives each candidate the probability that it is a secret.

The labelled findings that come with the module are generated by rule: credentials as they
stand in code and configuration, and look-alikes (card numbers, commit and checksum
digests, UUIDs, paths, identifiers, placeholders). Another table of the same columns
(candidate, before, after, path, label) can be given.

Defined cases: a null text has no candidates; a null path counts as empty; repeated rows are
each reported; candidates do not overlap; texts of any length are scanned whole, and a score at the threshold is a secret. A run of 16 characters none of whose parts between
signs has 16 and a digit is reported by its last part. A value assigned by ``${...}`` or ``$(...)``
is a reference, not a value. Other columns are not looked at. An empty table gives no findings.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm._shared import staged

CONTEXT = 80
THRESHOLD = 0.5
TREES, DEPTH, SEED = 40, 8, 7

# Words that look-alikes and placeholders are made of.
DICTIONARY = (
    "account", "admin", "and", "api", "back", "build", "cache", "change", "client", "code", "config", "content", "copy", "data", "default", "demo", "dummy",
    "example", "file", "fixture", "for", "from", "goes", "here", "home", "index", "insert", "key", "list", "main", "mock", "model", "module", "name", "number",
    "page", "part", "pass", "password", "placeholder", "prod", "release", "replace", "sample", "secret", "section", "server", "service", "src", "staging",
    "table", "test", "text", "the", "this", "token", "update", "user", "value", "version", "view", "with", "word", "your",
)
# Words and constants that stand after a secret word without being one.
COMMON = (
    "about", "always", "anna", "because", "company", "disabled", "enabled", "every", "everything", "false", "found", "given", "government", "hidden", "india", "invalid", "john", "london",
    "missing", "must", "never", "nobody", "none", "nothing", "null", "only", "optional", "people", "required", "should", "string", "there", "true", "undefined", "what", "world",
)
# Neighbouring words for and against.
SECRET_WORDS = "token|secret|passw|pwd|api[_ -]?key|apikey|access|auth|bearer|credential|private|client|signing"
OTHER_WORDS = "commit|sha|md5|hash|digest|checksum|uuid|guid|revision|card|phone|order|invoice|isbn|serial|etag|version|http"
SAMPLE_PATH = "test|example|sample|mock|fixture|doc"

LETTER, PLAIN = r"A-Za-z+/_\-", r"A-Za-z0-9+/_\-"
#: A part of 16 characters with a digit, with its padding; and any run of 16 with a digit but without such a part.
LONG = rf"(?=[{LETTER}]*+[0-9])[{PLAIN}]{{16}}"
PART = rf"(?<![{PLAIN}]){LONG}[{PLAIN}]*+(?:=++(?![{PLAIN}]))?"
GLUED = rf"(?<![{PLAIN}=])(?=[{LETTER}=]*+[0-9])(?=[{PLAIN}=]{{16}})(?![{PLAIN}=]*?(?<![{PLAIN}]){LONG})[{PLAIN}=]++"
NAME = rf"^[{PLAIN}=]*=(?=[{PLAIN}])"  # of a glued run
#: Between a name and its value, and the end of an assignment to a secret name.
SIGN = r"[\"'`]?[ \t]{0,16}[=:]{1,2}>?[ \t]{0,16}(?:(?i:bearer|basic)[ \t]{1,4})?[\"'`]?"
NAMED = rf"(?i:{SECRET_WORDS})[A-Za-z0-9_.\-]{{0,64}}{SIGN}"
BARE = r"[^\s\"'`&,;<>(){}\[\]|]"
VALUE = (
    # most places are behind a letter or one blank after a word: dismissed first
    rf"(?<=[=:>\s\"'`])(?:(?<![^=:>\"'`\s]\s)|(?<=[rRcC][ \t]))(?=[^\s\"'`&,;<>(){{}}\[\]|=:])(?!\$[{{(])(?!(?i:bearer|basic)[ \t]{{1,4}}[^\s])(?![{PLAIN}]+=+{LONG})(?<=[=:]>?[ \t]{{0,16}}(?:[A-Za-z]{{5,6}}[ \t]{{1,4}})?[\"'`]?)(?<={NAMED})"
    rf"(?:(?<=\")[^\"\s]+(?=\")|(?<=')[^'\s]+(?=')|(?<=`)[^`\s]+(?=`)|{BARE}*[^\s\"'`&,;<>(){{}}\[\]|.!?:])"
)
#: A web token, and the password before the host of a url.
TOKEN = rf"(?<![{PLAIN}])eyJ[A-Za-z0-9_\-]{{8,}}+\.[A-Za-z0-9_\-]{{8,}}+(?:\.[A-Za-z0-9_\-]++)?"
LOGIN = r"://[^\s/?#@:]{1,64}:"
PASSWORD = rf"(?<=[^\s/]:)(?<={LOGIN})[^\s/?#@:]{{1,256}}(?=@)"
RUN = f"{TOKEN}|{PASSWORD}|{PART}|{GLUED}|{VALUE}"


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    length = F.length(candidate)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A"), "[^9aA]", "_")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    bare = F.regexp_replace(F.lower(candidate), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    near = F.lower(F.right(before, F.lit(32)))
    last = F.lower(F.regexp_extract(before, r"([\p{L}_\-]{2,})[^\p{L}]*$", 1))

    def share(kept: str) -> Column:
        return F.length(F.regexp_replace(candidate, f"[^{kept}]", "")) / length

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    return {
        "length": length.cast("double"),
        "transitions": (runs - 1) / F.greatest(length - 1, F.lit(1)),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / length,
        "repeats": (length - F.length(F.regexp_replace(candidate, r"(.)\1+", "$1"))) / length,
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "hex": share("0-9a-fA-F"),
        "vowels": share("aeiouAEIOU"),
        "symbols": share(r"+/_=\-"),
        "dots": share("."),
        "dictionary": (length - F.length(bare)) / length,
        "slashes": (length - F.length(F.replace(candidate, F.lit("/"), F.lit("")))).cast("double"),
        "sample_path": flag(F.lower(path).rlike(SAMPLE_PATH)),
        "assigned": flag(before.rlike(r"[=:]>?\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "in_path": flag(before.rlike(r"[/.@]$")),
        "login": flag(before.rlike(f"{LOGIN}$") & after.rlike("^@")),
        "secret_word": flag(near.rlike(SECRET_WORDS)),
        "secret_last": flag(last.rlike(SECRET_WORDS)),
        "other_word": flag(near.rlike(OTHER_WORDS)),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, place (number of the candidate in its text), start, candidate, before, after, path."""
    path = docs["source"].cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.filter(F.col("text").rlike(RUN)).withColumn("row_id", F.monotonically_increasing_id())
    found = rows.select("doc_id", "row_id", "path", F.split("text", RUN, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("runs"))
    ends = F.transform("gaps", lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("tail"), F.left(g, F.lit(CONTEXT)).alias("head")))
    found = found.select("doc_id", "row_id", "path", "runs", ends.alias("gaps"))
    zipped = F.arrays_zip(F.col("runs"), F.col("gaps"), F.slice("gaps", F.lit(2), F.size("runs")).alias("next"), F.concat(F.array(F.lit("")), "runs").alias("last"))
    each = found.select("doc_id", "row_id", "path", F.size("runs").alias("n"), F.posexplode(zipped).alias("place", "z")).filter("place < n")
    so_far = Window.partitionBy("row_id").orderBy("place")  # of one text's candidates
    run, tail = F.col("z.runs"), F.col("z.gaps.tail")
    # a run that was found itself and is assigned to is the name of the next
    text_before = F.concat(F.when(tail.rlike(f"^{SIGN}$"), F.col("z.last")).otherwise(""), tail)
    name = F.when(text_before.rlike(f"(?:{NAMED}|{LOGIN})$"), "").otherwise(F.regexp_extract(run, NAME, 0))
    each = each.select(
        "doc_id", "place", "path", run.alias("run"), name.alias("name"), text_before.alias("text_before"), F.col("z.next.head").alias("after"),
        (F.sum(F.col("z.gaps.gap") + F.length(run)).over(so_far) - F.length(run)).alias("run_start"),
    )
    return each.select(
        "doc_id", "place", (F.col("run_start") + F.length("name")).alias("start"), F.substring("run", F.length("name") + 1, F.length("run")).alias("candidate"),
        F.right(F.concat("text_before", "name"), F.lit(CONTEXT)).alias("before"), "after", "path",
    )


def labelled_findings(spark: SparkSession, per_kind: int = 250) -> DataFrame:
    """Generated findings: candidate, before, after, path, label (1: a secret)."""
    i = F.col("id").cast("string")

    def hash_(salt: str, bits: int = 256) -> Column:
        return F.sha2(F.concat(i, F.lit(salt)), bits)

    def pick(salt: str, *values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.concat(i, F.lit(salt))), F.lit(len(values))) + 1).cast("int"))

    def prose(salt: str) -> Column:
        return pick(salt, "and then on ", "The value of ", "see also. ", "was given by ", "in the\n", "")

    md5 = F.md5(F.concat(i, F.lit("m")))
    plain = {
        "sha1": F.sha1(F.concat(i, F.lit("h"))), "md5": md5, "base64": F.regexp_replace(F.base64(F.unhex(hash_("b"))), "[^A-Za-z0-9+/]", "7"),
        "digits": F.left(F.regexp_replace(hash_("d", 512), "[^0-9]", ""), F.lit(16)),
        "uuid": F.concat_ws("-", F.left(md5, F.lit(8)), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12)),
        "number": (F.pmod(F.xxhash64(F.concat(i, F.lit("n"))), F.lit(900)) + 1).cast("string"), "same": F.repeat(pick("z", "x", "X", "0", "a", "1"), F.lit(20)),
        "quote": pick("q", '"', "'", ""), "open": pick("o", " = ", "=", ": ", " : ", ":"), "space": pick("w", " ", ": ", " = ", " "), "start": prose("1"),
        "secret_name": pick("s", "token", "secret", "password", "api_key", "API_KEY", "access_token", "auth", "client_secret", "TOKEN", "Bearer"),
        "other_name": pick("t", "commit", "sha1", "md5", "checksum", "revision", "digest", "etag"), "id_name": pick("u", "id", "uuid", "guid", "request"),
        "card_name": pick("c", "card ", "order ", "phone ", "invoice "), "end": pick("e", "", " of the", ". Then", "\n", ", and", "!!"),
        "passphrase": F.concat(pick("y", *COMMON), i, pick("k", "!", "#", "", "$")), "common": pick("g", *COMMON), "short": (F.pmod(F.xxhash64(F.concat(i, F.lit("l"))), F.lit(8)) + 8).cast("int"),
        "path": pick("a", "src0", "src17", "config.yaml", "app/settings.py", "tests/fixture.json", "docs/readme.md"), **{f"word{n}": pick(s, *DICTIONARY) for n, s in enumerate("pqrst")},
    }
    rows = staged(spark.range(0, per_kind, 1, 4).select(*[c.alias(k) for k, c in plain.items()]), "findings_parts")
    c = {k: F.col(k) for k in plain}
    digitless = F.translate("base64", "0123456789+/", "qWzKvXbTgHRm")
    words, letters, nothing = [c[f"word{n}"] for n in range(5)], F.regexp_replace("base64", "[+/]", "x"), F.lit("")
    # label, candidate, name before it, and how it follows the name: assigned, maybe assigned (None), directly, or before a host ("@")
    kinds = [
        (1, c["sha1"], c["secret_name"], True), (1, F.upper("sha1"), F.upper("secret_name"), True), (1, c["base64"], c["secret_name"], True), (1, c["md5"], c["secret_name"], True),
        (1, F.concat(F.lit("AKIA"), F.left(F.upper(letters), F.lit(16))), nothing, None), (1, F.concat(F.lit("ghp_"), F.left(letters, F.lit(36))), nothing, None),
        (1, F.concat(F.lit("sk_live_"), F.left(letters, F.lit(24))), c["secret_name"], True),
        (1, F.left(letters, c["short"]), c["secret_name"], True), (1, F.left(digitless, c["short"] * 2), c["secret_name"], True), (1, c["passphrase"], c["secret_name"], True),
        (0, c["common"], c["secret_name"], True), (0, F.initcap("common"), c["secret_name"], True), (0, words[0], c["secret_name"], True), (0, F.concat_ws("_", *words[:2]), c["secret_name"], True),
        (0, F.concat_ws(".", *words[:2]), c["secret_name"], True), (0, c["number"], c["secret_name"], True),
        (0, c["digits"], nothing, False), (0, c["digits"], c["card_name"], False),
        (0, c["sha1"], c["other_name"], None), (0, c["md5"], c["other_name"], None), (0, c["uuid"], c["id_name"], None),
        (0, F.concat_ws("/", *words[:3], c["number"]), nothing, False), (0, F.concat_ws("-", *words[:3], c["number"]), nothing, None),
        (0, F.concat_ws("_", *words, c["number"]), c["secret_name"], None), (0, F.concat(F.lit("your-"), words[0], F.lit("-token-goes-here-"), c["number"]), c["secret_name"], True),
        (1, F.concat(F.lit("eyJ"), F.left(letters, F.lit(17)), F.lit(".eyJ"), F.left(F.reverse(letters), F.lit(30)), F.lit("."), F.reverse(F.left(letters, F.lit(40)))), nothing, None),
        (1, F.concat(F.lit("eyJ"), F.left(letters, F.lit(17)), F.lit(".eyJ"), F.left(F.reverse(letters), F.lit(30)), F.lit("."), F.reverse(F.left(letters, F.lit(40)))), c["secret_name"], True),
        (1, F.left(letters, c["short"]), F.concat(F.lit("postgres://"), words[0], F.lit(":")), "@"), (1, c["passphrase"], F.concat(F.lit("https://"), words[1], F.lit(":")), "@"),
        (0, words[2], F.concat(F.lit("mysql://"), words[0], F.lit(":")), "@"), (0, F.concat_ws("_", *words[:2]), F.concat(F.lit("amqp://"), words[3], F.lit(":")), "@"),
        (0, F.concat_ws(".", words[0], words[1], c["number"], c["number"]), c["secret_name"], True), (0, c["sha1"], F.concat(c["secret_name"], F.lit(" fixed in commit")), False),
        (0, F.concat(c["same"], c["number"]), c["secret_name"], True), (0, F.concat(F.lit("http-"), c["sha1"]), F.lit("http://example.com/"), False),
    ]
    found = []
    for label, candidate, name, assigned in kinds:
        between = nothing if assigned == "@" else F.concat("open", "quote") if assigned else F.concat("space", "quote") if assigned is None else F.when(name.rlike("commit$"), " ").otherwise("")
        after = F.concat(F.lit("@"), words[4], F.lit("/db")) if assigned == "@" else F.concat(nothing if assigned is False else c["quote"], "end")
        found.append(F.struct(candidate.alias("candidate"), F.concat("start", name, between).alias("before"), after.alias("after"), c["path"].alias("path"), F.lit(label).alias("label")))
    return staged(rows.select(F.explode(F.array(*found)).alias("f")).select("f.*"), "findings")


def _described(rows: DataFrame) -> DataFrame:
    named = features(rows["candidate"], rows["before"], rows["after"], rows["path"])
    return rows.withColumns({f"f_{k}": F.coalesce(v, F.lit(0.0)) for k, v in named.items()})


def fit(findings: DataFrame) -> PipelineModel:
    names = [f"f_{k}" for k in features(*[F.lit("x")] * 4)]
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    rows = staged(_described(findings.withColumn("label", F.col("label").cast("double"))), "described")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, model: PipelineModel) -> DataFrame:
    """One row per candidate with its score and whether it is held to be a secret."""
    scored = model.transform(_described(candidates(docs)))
    score = F.round(vector_to_array(F.col("probability"))[1], 6)
    return scored.select("doc_id", "place", "start", "candidate", "before", "after", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))
