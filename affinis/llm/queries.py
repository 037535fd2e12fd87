"""The queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import chat_format, decontaminate, exact_dedup, language_id, packing, quality, secret_scan, sharding, simhash, url_filter
from affinis.llm._shared import table

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
QUALITY_FOLDS = 5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lying = sharding.reshard(spark, f"{sf_dir}/documents.parquet")
    text = F.col("row.text")
    return lying.select(
        F.col("row.doc_id").alias("doc_id"), sharding.byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = language_id.held_out(F.col("doc_id"), QUALITY_FOLDS, 0)
    model = quality.fit(docs, labels.filter(~held).select("doc_id", F.col("quality").alias("label")))
    scored = docs.select("doc_id", held.alias("held_out"), quality.scorer(spark, model)(docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", url_filter.judged(spark, pages["url"], URL_RULES).alias("j")).select("page_id", "j.*")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.placements(packing.tokenised(docs, tokenizer_path())).drop("row_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "place", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate"), 256).alias("candidate_sha256"), "score", "is_secret")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predicted(docs, language_model(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.filter(~language_id.held_out(docs["doc_id"])))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_format.formatted(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "kind", "call_id", "status", "effective_turn", F.array_join("errors", ";").alias("errors"), "json")


TOOL_SCHEMAS = [("search", "q", "string", True), ("search", "k", "integer", False), ("lookup", "q", "string", True), ("lookup", "k", "integer", True), ("lookup", "limit", "integer", True)]


def tool_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations whose assistant's turns are tool calls with identifiers, and whose user's turns are results.

    Some identifiers repeat, some results come before their calls, some calls need another's result, and
    arguments are ill-typed, unknown, incomplete or no object at all."""
    turn, k = F.col("turn"), F.col("turn").cast("string")
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    quoted = F.substring(text, 6, 1_000_000_000)  # with the closing brace
    quoted = F.substr(quoted, F.lit(1), F.length(quoted) - 1)

    def spelled(*parts) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    name = F.when(turn % 3 == 0, "search").when(turn % 3 == 1, "lookup").otherwise("none")
    own = F.when(turn % 6 == 5, "c1").otherwise(spelled("c", k))
    arguments = F.when(turn % 4 == 1, spelled('{"q": ', quoted, ', "k": "', k, '"}')).when(turn % 7 == 2, "[1]").otherwise(spelled('{"k": ', k, ', "q": ', quoted, "}"))
    needs = F.when(turn % 5 == 4, spelled('["c', (turn - 2).cast("string"), '"]')).otherwise("[]")
    call = spelled('{"tool_calls": [{"id": "', own, '", "name": "', name, '", "arguments": ', arguments, ', "depends_on": ', needs, "}]}")
    answered = F.when(turn % 4 == 2, turn + 1).otherwise(turn - 1).cast("string")
    result = spelled('{"tool_call_id": "c', answered, '", "content": ', quoted, "}")
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), F.when(role == "assistant", call).when(role == "tool", result).otherwise(F.col("text")).alias("text"))


def chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 on tool calls and results with identifiers of their own."""
    found = chat_format.formatted(tool_conversations(table(spark, sf_dir, "conversations")), TOOL_SCHEMAS)
    return found.select("conv_id", "turn", "role", "kind", "call_id", "status", "effective_turn", F.array_join("errors", ";").alias("errors"), "json")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_simhash, op3_quality, op4_url_filter, op5_packing, op6_exact_dedup, op7_secret_scan, op8_language_id, op9_chat_format, op10_decontaminate, chat_tool_links)
}

ORACLE_SQL = {
    "op4_url_filter": r"""
        WITH part AS (
          SELECT page_id, translate(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2) AS path
          FROM pages
        ), rules(rule_host, rule_path, verdict) AS (
          VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), ranked AS (
          SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, r.rule_host || r.rule_path AS rule, r.verdict,
                 row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule_host || r.rule_path) DESC) AS n
          FROM part p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
    """,
    "op6_exact_dedup": r"""
        WITH rows AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) = 1 AS kept, text_sha256
        FROM rows
    """,
    "op9_chat_format": r"""
        WITH nodes AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
                 CASE role WHEN 'user' THEN 'turn:' || (turn + 1) WHEN 'assistant' THEN 'turn:' || turn END AS call_id
          FROM conversations
        )
        SELECT conv_id, turn, role, kind, call_id,
               CASE WHEN kind = 'call' THEN CASE WHEN EXISTS (SELECT 1 FROM nodes o WHERE o.kind = 'result' AND o.conv_id = n.conv_id AND o.call_id = n.call_id) THEN 'linked' ELSE 'unanswered' END
                    WHEN kind = 'result' THEN CASE WHEN EXISTS (SELECT 1 FROM nodes o WHERE o.kind = 'call' AND o.conv_id = n.conv_id AND o.call_id = n.call_id) THEN 'linked' ELSE 'unasked' END END AS status,
               turn AS effective_turn, CASE WHEN kind = 'call' THEN '' END AS errors,
               CASE kind WHEN 'call' THEN '{"arguments":{"content":' || to_json(text) || '},"id":"' || call_id || '","name":"reply","role":"user"}'
                         WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || call_id || '","role":"assistant"}'
                         ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
        FROM nodes n
    """,
    "chat_tool_links": r"""
        WITH RECURSIVE nodes AS (
          SELECT conv_id, turn, CASE role WHEN 'user' THEN 'tool' ELSE role END AS role, coalesce(text, '') AS text, CASE role WHEN 'assistant' THEN 'call' WHEN 'user' THEN 'result' ELSE 'message' END AS kind,
                 CASE role WHEN 'assistant' THEN CASE WHEN turn % 6 = 5 THEN 'c1' ELSE 'c' || turn END WHEN 'user' THEN 'c' || CASE WHEN turn % 4 = 2 THEN turn + 1 ELSE turn - 1 END END AS call_id,
                 CASE WHEN role = 'assistant' AND turn % 5 = 4 THEN 'c' || (turn - 2) END AS needs
          FROM conversations
        ), point AS (
          SELECT conv_id, kind, call_id, min(turn)::BIGINT AS turn FROM nodes WHERE kind <> 'message' GROUP BY ALL
        ), edge AS (  -- what has to come before what
          SELECT c.conv_id, 'call' AS from_kind, c.call_id AS from_id, 'result' AS kind, c.call_id FROM point c JOIN point r USING (conv_id, call_id) WHERE c.kind = 'call' AND r.kind = 'result'
          UNION SELECT n.conv_id, 'result', n.needs, 'call', n.call_id FROM nodes n JOIN point r ON r.conv_id = n.conv_id AND r.kind = 'result' AND r.call_id = n.needs WHERE n.needs IS NOT NULL
        ), reach AS (
          SELECT conv_id, kind, call_id, turn FROM point
          UNION SELECT r.conv_id, e.kind, e.call_id, r.turn FROM reach r JOIN edge e ON e.conv_id = r.conv_id AND e.from_kind = r.kind AND e.from_id = r.call_id
        ), latest AS (
          SELECT conv_id, kind, call_id, max(turn) AS eff FROM reach GROUP BY ALL
        ), counts AS (
          SELECT conv_id, call_id, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results FROM nodes WHERE kind <> 'message' GROUP BY ALL
        ), described AS (
          SELECT n.*, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'none' END AS name, turn % 4 <> 1 AND turn % 7 = 2 AS listed, turn % 4 = 1 AS ill_typed
          FROM nodes n
        )
        SELECT n.conv_id, n.turn, n.role, n.kind, n.call_id,
               CASE n.kind WHEN 'call' THEN CASE WHEN results = 0 THEN 'unanswered' WHEN calls > 1 THEN 'repeated' ELSE 'linked' END
                           WHEN 'result' THEN CASE WHEN calls = 0 THEN 'unasked' WHEN results > 1 THEN 'repeated' ELSE 'linked' END END AS status,
               greatest(n.turn, coalesce(eff, n.turn)) AS effective_turn,
               CASE WHEN n.kind = 'call' THEN CASE WHEN name = 'none' THEN 'unknown tool' WHEN listed THEN 'arguments are no object'
                    ELSE concat_ws(';', CASE WHEN ill_typed THEN 'wrong type of k' END, CASE WHEN name = 'lookup' THEN 'missing limit' END) END END AS errors,
               CASE n.kind WHEN 'call' THEN '{"arguments":' || CASE WHEN listed THEN '[1]' WHEN ill_typed THEN '{"k":"' || n.turn || '","q":' || to_json(text) || '}' ELSE '{"k":' || n.turn || ',"q":' || to_json(text) || '}' END
                                        || ',"id":"' || n.call_id || '","name":"' || name || '","role":"assistant"}'
                           WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || n.call_id || '","role":"tool"}'
                           ELSE '{"content":' || to_json(text) || ',"role":' || to_json(n.role) || '}' END AS json
        FROM described n LEFT JOIN latest l ON l.conv_id = n.conv_id AND l.kind = n.kind AND l.call_id = n.call_id LEFT JOIN counts c ON c.conv_id = n.conv_id AND c.call_id = n.call_id
    """,
    "op10_decontaminate": r"""
        WITH doc AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents
        ), item AS (
          SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), win AS (
          SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS phrase
          FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM item WHERE len(w) > 0)
        ), place AS (
          SELECT d.doc_id, s.n, d.k, array_to_string(d.w[d.k:d.k + s.n - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM doc) d JOIN (SELECT DISTINCT n FROM win) s ON d.k + s.n - 1 <= len(d.w)
        ), hit AS (
          SELECT p.doc_id, p.k, p.n, win.item_id FROM place p JOIN win ON p.n = win.n AND p.phrase = win.phrase
        ), covered AS (
          SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY doc_id
        ), items AS (
          SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id
        )
        SELECT doc.doc_id, len(doc.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
