"""Chat formatting: tool calls linked to their results (DataFrame operations only).

An assistant turn may hold ``{"content": ..., "tool_calls": [{"id", "name", "arguments"}]}``; a
tool turn holds ``{"tool_call_id", "content"}``.  Calls and results are hash-joined on
(conversation, identifier).  The result has a row for each message, call and result, with

- ``order_turn, depth, part``: the ranks of a topological order - a call stands after its message, a result
  after its call, even where the log has them the other way round;
- ``place``: the row's number in that order of its conversation, from 1; equal ranks go by kind, turn and JSON;
- ``link``: ``linked``, ``unanswered`` (call), ``orphan`` (result without call), null (message);
- ``arguments_valid``: whether a call's arguments meet the tool's schema (null: not a call);
- ``json``: canonical JSON - keys in alphabetical order, no white space.

Defined cases: a text that is no such object is a plain message; null role or text is JSON null,
left out; an identifier that several calls of a conversation use belongs to the earliest; further
results of one call stay, each as a row; a null turn sorts first; repeated rows stay, each with a place; an empty
table gives an empty result; further columns are left out.  Links are equi-joins, and places are counted by
stretches of ``TURNS`` turns, so that one long conversation is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table

#: Tool -> parameter -> (JSON type, required).
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}
#: Turns that are numbered together.
TURNS = 1024
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*"}


def _valid(tool: Column, args: Column, schemas: dict) -> Column:
    out = F.lit(False)
    keys = F.map_keys(F.try_variant_get(args, "$", "map<string,variant>"))
    for name, params in schemas.items():
        good = F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(p) for p in params]))) == 0, F.lit(False))
        for p, (kind, required) in params.items():
            found = F.try_variant_get(args, f"$['{p}']", "variant")
            fits = F.schema_of_variant(found).rlike(f"^({KINDS[kind]})$")
            good = good & F.coalesce(fits, F.lit(not required))
        out = F.when(tool == name, good).otherwise(out)
    return F.coalesce(out, F.lit(False))


def link(conversations: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Messages, calls and results in topological order, each as canonical JSON."""
    shape = F.when(F.col("role").isin("assistant", "tool") & F.startswith(F.ltrim("text"), F.lit("{")), F.try_parse_json("text"))
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("v", shape)
    listed = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    turns = turns.withColumns({"listed": listed, "answers": F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))})

    given = lambda c: F.try_variant_get(c, "$.arguments", "variant")
    read = lambda c: F.coalesce(F.try_parse_json(F.try_variant_get(c, "$.arguments", "string")), given(c))
    parts = lambda c: F.struct(read(c).alias("arguments"), F.try_variant_get(c, "$.id", "string").alias("id"), F.try_variant_get(c, "$.name", "string").alias("name"))
    content = F.when(F.col("listed").isNotNull(), F.try_variant_get("v", "$.content", "string")).otherwise(F.col("text"))
    said = F.to_json(F.struct(content.alias("content"), "role"))
    with_calls = F.to_json(F.struct(content.alias("content"), F.col("role"), F.transform("listed", parts).alias("tool_calls")))
    none = lambda kind: F.lit(None).cast(kind)
    messages = turns.where("answers is null").select(
        "conv_id", "turn", F.lit("message").alias("kind"), "role", none("string").alias("call_id"), none("string").alias("tool"), F.col("turn").alias("order_turn"), F.lit(0).alias("depth"), F.lit(0).alias("part"),
        none("string").alias("link"), none("boolean").alias("arguments_valid"), F.when(F.col("listed").isNotNull(), with_calls).otherwise(said).alias("json"),
    )

    calls = turns.where("listed is not null").select("conv_id", "turn", F.posexplode("listed").alias("part", "c"))
    calls = calls.select("conv_id", "turn", "part", F.inline(F.array(parts(F.col("c")))))
    results = turns.where("answers is not null").select("conv_id", "turn", F.col("answers").alias("call_id"), F.try_variant_get("v", "$.content", "variant").alias("content"))
    first = calls.where("id is not null").groupBy(F.col("conv_id").alias("k"), F.col("id").alias("i")).agg(F.min(F.struct("turn", "part", "name")).alias("call"))
    answered = results.groupBy(F.col("conv_id").alias("k"), F.col("call_id").alias("i")).agg(F.lit(True).alias("answered"))

    same = lambda name: F.col("conv_id").eqNullSafe(F.col("k")) & (F.col(name) == F.col("i"))
    call_rows = calls.join(answered, same("id"), "left").select(
        "conv_id", "turn", F.lit("call").alias("kind"), F.lit("assistant").alias("role"), F.col("id").alias("call_id"), F.col("name").alias("tool"), F.col("turn").alias("order_turn"), F.lit(1).alias("depth"), "part",
        F.when(F.col("answered"), "linked").otherwise("unanswered").alias("link"), _valid(F.col("name"), F.col("arguments"), schemas).alias("arguments_valid"), F.to_json(F.struct("arguments", "id", "name")).alias("json"),
    )
    found = F.col("call").isNotNull()
    result_rows = results.join(first, same("call_id"), "left").select(
        "conv_id", "turn", F.lit("result").alias("kind"), F.lit("tool").alias("role"), "call_id", F.col("call.name").alias("tool"), F.greatest("turn", "call.turn").alias("order_turn"), F.lit(2).alias("depth"), F.coalesce("call.part", F.lit(0)).alias("part"),
        F.when(found, "linked").otherwise("orphan").alias("link"), none("boolean").alias("arguments_valid"),
        F.to_json(F.struct("content", F.col("call.name").alias("name"), F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("json"),
    )
    return numbered(messages.unionByName(call_rows).unionByName(result_rows))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their places: those before their stretch of turns, and their number within it."""
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("order_turn") / TURNS), F.lit(-1)))
    sizes = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("conv_id").alias("k"), F.col("stretch").alias("i"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("order_turn"), "depth", "part", "kind", F.asc_nulls_first("turn"), "json")
    found = rows.withColumn("number", F.row_number().over(order)).join(before, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("stretch") == F.col("i")))
    return found.withColumn("place", F.col("before") + F.col("number")).drop("stretch", "k", "i", "before", "number")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, linked and serialised."""
    return link(table(spark, sf_dir, "conversations"))


ORACLE = {
    # The tables hold no tool calls; rows that do would be missing here and show as a mismatch.
    "op5_chat_format": """
        SELECT conv_id, turn, 'message' AS kind, role, NULL::VARCHAR AS call_id, NULL::VARCHAR AS tool, turn AS order_turn,
               0 AS depth, 0 AS part, NULL::VARCHAR AS link, NULL::BOOLEAN AS arguments_valid,
               CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, CAST(json_object('content', text, 'role', role) AS VARCHAR)) AS place
        FROM conversations
        WHERE NOT (role IN ('assistant', 'tool') AND starts_with(ltrim(text), '{') AND coalesce(json_valid(text), false))
    """,
}
