"""Chat formatting with linked tool calls.

A message's text may be a JSON object: {"content": ..., "tool_calls": [{"id",
"name", "arguments"}]} calls tools, and {"tool_call_id": ..., "content": ...}
in a message of role tool is a result. Anything else is plain content. Calls
and results are hash-joined by conversation and identifier, salted so that one
identifier's results spread. Arguments are checked against the tools' schemas.

Order: messages stand by turn, but a result that was recorded before its call
moves behind it. Links lead from calls to results alone, so (place, depth,
turn) sorts every link forwards: depth is 0 for a call and 1 for a result.

Canonical JSON has its keys sorted, no white space, and numbers as a variant
prints them.

Defined cases. Null text is empty content, null role is "". Null conversation
ids form one conversation without links. Identifiers that repeat in calls mean
the earliest call. A result without a call is an orphan, a call without a
result is open; both stay. Broken JSON is plain content. Rows that repeat stay
as often as they stand there; columns beyond the named ones are ignored. Long
texts need no cut; a message of JSON that a variant cannot hold (128 MB) counts
as broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tools known to the query: name, then parameter: (type, required). Types are those of JSON.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "weather": {"place": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}
# Which variant types a JSON type takes.
TYPES = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$",
}
SALTS = 16
CALLS = "array<struct<id:string,name:string,arguments:variant>>"


def canonical(v: Column) -> Column:
    return F.to_json(v)


def schema_errors(name: Column, args: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call, as sorted strings; none if it fits its tool's schema."""
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    keys = F.map_keys(F.coalesce(F.from_json(F.to_json(args), "map<string,string>"), F.create_map().cast("map<string,string>")))
    for tool, parameters in tools.items():
        wrong = []
        for p, (kind, required) in parameters.items():
            value = F.try_variant_get(args, "$." + p, "variant")
            there = F.array_contains(keys, p)
            wrong.append(F.when(there & ~F.schema_of_variant(value).rlike(TYPES[kind]), F.lit(f"{p} is not {kind}")))
            if required:
                wrong.append(F.when(~there, F.lit(f"{p} is missing")))
        known = F.array([F.lit(p) for p in parameters]).cast("array<string>")
        extra = F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(" is not known")))
        bad = F.array_sort(F.concat(F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>"), extra))
        bad = F.when(F.coalesce(F.schema_of_variant(args), F.lit("")).startswith("OBJECT"), bad).otherwise(F.array(F.lit("arguments are not an object")))
        out = F.when(name == tool, bad).otherwise(out)
    return out


def parse(messages: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    v = F.when(text.startswith("{"), F.try_parse_json(text))
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), v.alias("v"))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", CALLS))
    result = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    known = F.coalesce(F.size(calls) > 0, F.lit(False)) | result.isNotNull()
    content = F.when(known, F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit(""))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", content.alias("content"), F.when(F.size(calls) > 0, calls).alias("calls"), result.alias("result_of"))


def format_chat(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, place, depth, role, n_calls, n_errors, link, json.

    Sorting a conversation by (place, depth, turn, json) puts calls before their results. link: call, linked,
    orphan or null. A conversation is never collected into one cell.
    """
    rows = parse(messages, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    first = rows.filter(F.col("calls").isNotNull()).select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("id"))
    first = first.filter(F.col("id").isNotNull()).groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"))
    first = first.withColumn("salt", F.explode(F.array([F.lit(k).cast("long") for k in range(SALTS)])))
    results = rows.filter(F.col("result_of").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("turn", "content"), F.lit(SALTS)))
    linked = results.join(first.withColumnRenamed("id", "result_of"), ["conv_id", "result_of", "salt"], "left").drop("salt")
    others = rows.filter(F.col("result_of").isNull()).withColumn("call_turn", F.lit(None).cast("long"))
    every = linked.select(*others.columns).unionByName(others)

    def call(c) -> Column:
        wrong = schema_errors(c["name"], c["arguments"], tools)
        return F.struct(c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments"), wrong.alias("errors"))

    checked = every.withColumn("checked", F.transform("calls", call))

    def text_json(c: Column) -> Column:
        """A JSON string: what an object of that one value holds behind {"s": and before }."""
        return F.regexp_replace(F.substring(F.to_json(F.struct(c.alias("s"))), 6, (1 << 31) - 1), r"\}\z", "")

    def call_json(c) -> Column:
        return F.concat(
            F.lit('{"arguments":'), F.coalesce(canonical(c["arguments"]), F.lit("null")), F.lit(',"id":'), F.coalesce(text_json(c["id"]), F.lit("null")),
            F.lit(',"name":'), F.coalesce(text_json(c["name"]), F.lit("null")), F.lit("}"),
        )

    body = F.concat(
        F.lit('{"content":'), text_json(F.col("content")), F.lit(',"role":'), text_json(F.col("role")),
        F.when(F.col("result_of").isNotNull(), F.concat(F.lit(',"tool_call_id":'), text_json(F.col("result_of")))).otherwise(""),
        F.when(F.col("calls").isNotNull(), F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("calls", call_json), ","), F.lit("]"))).otherwise(""),
        F.lit("}"),
    )
    errors = F.aggregate(F.transform("checked", lambda c: F.size(c["errors"])), F.lit(0), lambda a, x: a + x)
    link = F.when(F.col("calls").isNotNull(), F.lit("call")).when(F.col("call_turn").isNotNull(), F.lit("linked")).when(F.col("result_of").isNotNull(), F.lit("orphan"))
    return checked.select(
        "conv_id", "turn", F.greatest("turn", "call_turn").alias("place"), F.when(F.col("call_turn").isNotNull(), 1).otherwise(0).alias("depth"), "role",
        F.coalesce(F.size("calls"), F.lit(0)).cast("long").alias("n_calls"), F.coalesce(errors, F.lit(0)).cast("long").alias("n_errors"), link.alias("link"), body.alias("json"),
    )


def op4(spark, sf_dir) -> DataFrame:
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
