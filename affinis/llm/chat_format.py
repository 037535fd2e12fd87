"""Chat formatting by tool-call linking, in DataFrame functions only.

Messages become nodes: tool calls, results and plain messages. A call is linked with its
result by a hash join on conversation and call id. Nodes are put into a topological
order (a result after its call, a call after the results it names in ``depends_on``), a
call's arguments are validated against the schema of its tool, and every node is serialised
as canonical JSON (sorted keys, no white space).

Tool messages are JSON texts: of an assistant ``{"tool_calls": [{"id", "name",
"arguments", "depends_on"}]}``, of a tool ``{"tool_call_id", "content"}``. In a conversation
without one of these a user's turn is a call of the tool ``reply`` with its text as ``content``,
and the assistant's turn that follows it is the result; in a conversation with one, turns that
are no tool messages are plain messages.

The order is the key (effective_turn, hops, turn, part): a node keeps its own turn unless
something it needs comes later; then it takes that one's effective turn and stands behind it.
No conversation is gathered in one task: nodes without late needs are ordered by their own
rows, and the others get their keys in grouped steps over the edges concerned.

Defined cases: null conv_id, turn or role are kept, and a null conv_id or turn links nothing; a
null text is an empty one; a text that is not valid JSON is a plain message. Of several
results with one call id all are returned and linked, and marked ``repeated`` where the id
occurs more than once. Nodes on or behind a cycle of needs are marked ``cyclic``, and keep the
key they had when that was found. A message without conv_id is a conversation of its own. Texts
of any length are handled whole. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm._shared import staged

TOOL_MESSAGE = "tool_calls array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>, tool_call_id string, content string"
#: tool, field, JSON type and whether it must be there.
SCHEMAS = [("reply", "content", "string", True)]
REPLY = "reply"


def nodes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, kind (call, result, message), call_id, name, arguments, depends_on, content."""
    rows = messages.select(
        messages["conv_id"].alias("conv_id"), messages["turn"].cast("long").alias("turn"), messages["role"].alias("role"), F.coalesce(messages["text"], F.lit("")).alias("text")
    )
    is_json = F.col("text").rlike(r"^\s*\{") & F.col("role").isin("assistant", "tool")
    parsed = rows.withColumn("m", F.when(is_json, F.from_json("text", TOOL_MESSAGE)))
    calls, result = F.col("m.tool_calls"), F.col("m.tool_call_id")
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size(calls) > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & result.isNotNull(), F.lit(False))
    # only in a conversation without tool messages are a user's and an assistant's turns call and result
    with_tools = parsed.filter(is_call | is_result).select(F.col("conv_id").alias("tool_conv")).distinct()
    parsed = parsed.join(with_tools, F.col("conv_id") == F.col("tool_conv"), "left")
    implied = F.col("tool_conv").isNull()
    entry = "array<struct<kind: string, call_id: string, name: string, arguments: string, depends_on: array<string>, content: string>>"

    def node(kind: str, **fields: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[fields.get(k, F.lit(None)).alias(k) for k in ("call_id", "name", "arguments", "depends_on", "content")])

    own = F.struct(F.col("text").alias("content"))
    later = F.concat(F.lit("turn:"), (F.col("turn") + 1).cast("string"))
    parts = (
        F.when(is_call, F.transform(calls, lambda c: node("call", call_id=c["id"], name=c["name"], arguments=c["arguments"], depends_on=c["depends_on"])).cast(entry))
        .when(is_result, F.array(node("result", call_id=result, content=F.col("m.content"))).cast(entry))
        .when(implied & (F.col("role") == "user"), F.array(node("call", call_id=later, name=F.lit(REPLY), arguments=F.to_json(own))).cast(entry))
        .when(implied & (F.col("role") == "assistant"), F.array(node("result", call_id=F.concat(F.lit("turn:"), F.col("turn").cast("string")), content=F.col("text"))).cast(entry))
        .otherwise(F.array(node("message", content=F.col("text"))).cast(entry))
    )
    return parsed.select("conv_id", "turn", "role", F.posexplode(parts).alias("part", "n")).select("conv_id", "turn", "part", "role", "n.*")


def linked(found: DataFrame) -> DataFrame:
    """The nodes with ``status``: linked, repeated, unanswered (a call), unasked (a result), or null for messages.

    Both sides of the join are counts per identifier, which are summed map-side."""
    per_id = found.filter("kind <> 'message' and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.sum((F.col("kind") == "call").cast("long")).alias("n_calls"), F.sum((F.col("kind") == "result").cast("long")).alias("n_results")
    )
    both = found.join(per_id, ["conv_id", "call_id"], "left")
    mine, other = (F.when(F.col("kind") == "call", F.col(a)).otherwise(F.col(b)) for a, b in (("n_calls", "n_results"), ("n_results", "n_calls")))
    status = F.when(F.col("kind") == "message", None).when(F.coalesce(other, F.lit(0)) == 0, F.when(F.col("kind") == "call", "unanswered").otherwise("unasked"))
    return both.select(*found.columns, status.when(mine > 1, "repeated").otherwise("linked").alias("status"))


def ordered(found: DataFrame) -> DataFrame:
    """The nodes with effective_turn, hops and cyclic."""
    usable = found.filter("conv_id is not null and turn is not null and call_id is not null")
    point = usable.groupBy("conv_id", "kind", "call_id").agg(F.min("turn").alias("turn"))
    calls, results = (point.filter(F.col("kind") == k).select("conv_id", "call_id", "kind", "turn") for k in ("call", "result"))
    answers = calls.join(results.select("conv_id", "call_id", F.col("turn").alias("other")), ["conv_id", "call_id"])
    edges = answers.select("conv_id", F.lit("call").alias("from_kind"), F.col("call_id").alias("from_id"), F.lit("result").alias("kind"), "call_id", "turn", F.col("other").alias("to_turn"))
    needs = usable.filter("kind = 'call' and size(depends_on) > 0").select("conv_id", "call_id", F.explode("depends_on").alias("from_id")).distinct()
    needs = needs.join(calls.select("conv_id", "call_id", F.col("turn").alias("to_turn")), ["conv_id", "call_id"])
    needs = needs.join(results.select("conv_id", F.col("call_id").alias("from_id"), "turn"), ["conv_id", "from_id"])
    edges = edges.unionByName(needs.select("conv_id", F.lit("result").alias("from_kind"), "from_id", F.lit("call").alias("kind"), "call_id", "turn", "to_turn"))
    late = staged(edges.filter("turn >= to_turn").select("conv_id").distinct(), "late")
    no_change = found.select("*", F.col("turn").alias("effective_turn"), F.lit(0).cast("long").alias("hops"), F.lit(False).alias("cyclic"))
    if late.isEmpty():
        return no_change
    edges = staged(edges.join(late, "conv_id", "left_semi").select("conv_id", "from_kind", "from_id", "kind", "call_id", "to_turn"), "needs")
    keys = staged(point.join(late, "conv_id", "left_semi").select("*", F.col("turn").alias("eff"), F.lit(0).cast("long").alias("hops"), F.lit(False).alias("cyclic")), "keys")
    while True:
        came = keys.select("conv_id", F.col("kind").alias("from_kind"), F.col("call_id").alias("from_id"), "eff", "hops")
        pushed = edges.join(came, ["conv_id", "from_kind", "from_id"]).filter("eff >= to_turn").groupBy("conv_id", "kind", "call_id")
        pushed = pushed.agg(F.max(F.struct("eff", (F.col("hops") + 1).alias("hops"))).alias("p"))
        members = keys.groupBy("conv_id", "eff").agg(F.count("*").alias("members"))
        step = keys.join(members, ["conv_id", "eff"]).join(pushed, ["conv_id", "kind", "call_id"], "left")
        later = F.coalesce(F.col("p") > F.struct("eff", "hops"), F.lit(False)) & ~F.col("cyclic")
        looped = later & (F.col("p.eff") == F.col("eff")) & (F.col("p.hops") > F.col("members"))  # more steps than nodes
        moved = later & ~looped
        step = step.select(
            "conv_id", "kind", "call_id", "turn", F.when(moved, F.col("p.eff")).otherwise(F.col("eff")).alias("eff"),
            F.when(moved, F.col("p.hops")).otherwise(F.col("hops")).alias("hops"), (F.col("cyclic") | looped).alias("cyclic"), (moved | looped).alias("changed"),
        )
        step = staged(step, "keys")
        keys = step.drop("changed")
        if step.filter("changed").isEmpty():
            break
    keys = keys.select("conv_id", "kind", "call_id", "eff", F.col("hops").alias("h"), F.col("cyclic").alias("c"))
    joined = found.join(keys, ["conv_id", "kind", "call_id"], "left")
    raised = F.col("eff") > F.col("turn")
    return joined.select(
        *found.columns, F.when(raised, F.col("eff")).otherwise(F.col("turn")).alias("effective_turn"),
        F.when(F.col("eff") >= F.col("turn"), F.col("h")).otherwise(F.lit(0)).cast("long").alias("hops"), F.coalesce("c", F.lit(False)).alias("cyclic"),
    )


def validated(found: DataFrame, schemas: list[tuple[str, str, str, bool]] = SCHEMAS) -> DataFrame:
    """The nodes with ``errors`` (array) for calls: unknown tool, arguments that are no object, missing, unknown and ill-typed fields."""
    spark = found.sparkSession
    fields = F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias("fields")
    tools = spark.createDataFrame(schemas, "name string, field string, type string, required boolean").groupBy("name").agg(fields)
    rows = found.join(F.broadcast(tools), "name", "left")  # the tools' schemas, given by the caller
    rows = rows.withColumn("v", F.try_parse_json("arguments")).withColumn("args", F.expr("try_variant_get(v, '$', 'map<string, variant>')"))
    rows = rows.withColumn("types", F.expr("transform_values(args, (k, x) -> schema_of_variant(x))"))

    def fits(f: Column) -> Column:
        have = F.col("types")[f["field"]]
        prefix = {"array": "ARRAY", "object": "OBJECT", "string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT"}
        test = F.when(f["type"] == "number", have.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
        for name, start in prefix.items():
            test = test.when(f["type"] == name, have.startswith(start))
        return test.otherwise(F.lit(True))

    def error(f: Column) -> Column:
        there = F.coalesce(F.map_contains_key("args", f["field"]), F.lit(False))
        return F.when(~there & f["required"], F.concat(F.lit("missing "), f["field"])).when(there & ~fits(f), F.concat(F.lit("wrong type of "), f["field"]))

    known = F.transform("fields", lambda f: f["field"])
    extra = F.transform(F.array_sort(F.array_except(F.map_keys("args"), known)), lambda k: F.concat(F.lit("unknown "), k))
    wrong = F.filter(F.transform("fields", error), lambda e: e.isNotNull())
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).when(F.col("args").isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.concat(wrong, extra))
    return rows.select(*found.columns, "v", F.when(F.col("kind") == "call", errors).alias("errors"))


def formatted(messages: DataFrame, schemas: list[tuple[str, str, str, bool]] = SCHEMAS) -> DataFrame:
    """One row per node, with its link, order, errors and canonical JSON."""
    found = validated(ordered(linked(nodes(messages))), schemas)
    arguments = F.coalesce(F.col("v"), F.try_parse_json(F.to_json(F.struct(F.col("arguments").alias("text")))))
    call = F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", "role"))
    other = F.to_json(F.struct("content", F.when(F.col("kind") == "result", F.col("call_id")).alias("id"), "role"))
    json = F.when(F.col("kind") == "call", call).otherwise(other)
    return found.select("conv_id", "turn", "part", "role", "kind", "call_id", "status", "effective_turn", "hops", "cyclic", "errors", json.alias("json"))
