"""Conversations as arrays of messages: validation, turns, packing, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role: string, content: string, reasoning_content: string, tools: string, tool_calls: string>>"


def parsed(df: DataFrame, payload: str = "payload_json") -> DataFrame:
    """Adds ``conv``, the messages of a stored payload; null where it isn't readable."""
    return df.withColumn("conv", F.from_json(payload, f"conversations {MESSAGES}")["conversations"])


def user_prompt(conv: Column) -> Column:
    """The user contents joined by newlines."""
    return F.array_join(F.transform(F.filter(conv, lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def canonical(conv: Column) -> Column:
    """Roles mapped to the four names, contents trimmed, empty fields null."""
    role = lambda m: F.when(m["role"].isin("human", "prompter"), "user").when(m["role"].isin("gpt", "bot"), "assistant").when(m["role"].isin("function", "observation"), "tool").otherwise(m["role"])
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.transform(conv, lambda m: F.struct(role(m).alias("role"), F.coalesce(F.trim(m["content"]), F.lit("")).alias("content"), clean(m["reasoning_content"]).alias("reasoning_content"), clean(m["tools"]).alias("tools"), clean(m["tool_calls"]).alias("tool_calls")))


def schema_reason(conv: Column) -> Column:
    """The first fault of a conversation, or null: no messages, unknown role, system not first, empty content, no user or assistant."""
    roles = F.transform(conv, lambda m: m["role"])
    has = lambda r: F.array_contains(roles, r)
    return (
        F.when(conv.isNull() | (F.size(conv) == 0), "empty")
        .when(F.exists(roles, lambda r: r.isNull() | ~r.isin("system", "user", "assistant", "tool")), "role")
        .when(F.array_contains(F.slice(roles, 2, F.greatest(F.size(roles), F.lit(1))), "system"), "system_position")
        .when(F.exists(conv, lambda m: (F.trim(F.coalesce(m["content"], F.lit(""))) == "") & m["tool_calls"].isNull()), "content")
        .when(~has("user") | ~has("assistant"), "turns")
    )


def turns(df: DataFrame, key: str) -> DataFrame:
    """``(key, turn, pos, role, content, calls, answers)``: a turn starts at each user message; turn 0 is what stands before the first.

    Turn numbers are counted within the array, so nothing is shuffled.
    """
    seen = F.transform("conv", lambda m, i: F.struct(m.alias("m"), F.size(F.filter(F.slice("conv", F.lit(1), i + 1), lambda x: x["role"] == "user")).alias("turn")))
    rows = df.select(key, F.posexplode(seen).alias("pos", "s"))
    calls = F.coalesce(F.json_array_length("s.m.tool_calls"), F.lit(0))
    return rows.select(key, F.col("s.turn").alias("turn"), "pos", F.col("s.m.role").alias("role"), F.col("s.m.content").alias("content"), calls.alias("calls"), (F.col("s.m.role") == "tool").cast("int").alias("answers"))


def packed_turns(sizes: Column, limit: int, system: Column | int = 0) -> Column:
    """Chunk number of each turn, packed greedily in order so that a chunk with its system message stays within ``limit``; -1 for a turn too large."""
    system = system if isinstance(system, Column) else F.lit(system)
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("chunk"), F.lit(-1).cast("long").alias("used"))

    def step(acc: Column, n: Column) -> Column:
        n = n.cast("long")
        over = n + system > limit
        fits = (acc["used"] >= 0) & (acc["used"] + n <= limit)
        chunk = F.when(over | fits, acc["chunk"]).otherwise(F.when(acc["used"] < 0, acc["chunk"]).otherwise(acc["chunk"] + 1))
        used = F.when(over, acc["used"]).when(fits, acc["used"] + n).otherwise(n + system)
        return F.struct(F.concat(acc["at"], F.array(F.when(over, F.lit(-1)).otherwise(chunk))).alias("at"), chunk.alias("chunk"), used.alias("used"))

    return F.aggregate(sizes, start, step)["at"]


def without_last(conv: Column) -> Column:
    """The prompt: all but the last message."""
    return F.slice(conv, 1, F.greatest(F.size(conv) - 1, F.lit(0)))


def decisions(df: DataFrame, key: str) -> DataFrame:
    """``(key, pos, context_size, role, content)``: one row for each assistant message, with the size of what precedes it."""
    rows = df.select(key, F.posexplode("conv").alias("pos", "m")).filter("m.role = 'assistant'")
    return rows.select(key, "pos", F.col("pos").alias("context_size"), "m.content")


#: Other names of the four roles (fixed values).
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "function": "tool", "observation": "tool"}


def message_fault(m: Column) -> Column:
    """Why a message can't be made canonical, or null: the first of role, tools, tool_calls (no list of JSON), then what stands on the wrong role, then no content."""
    role = F.lower(F.trim(m["role"]))
    for name, kind in ROLE_NAMES.items():
        role = F.when(role == name, kind).otherwise(role)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    listed = lambda c: blank(c) | (F.coalesce(F.json_array_length(c), F.lit(0)) > 0)
    return (
        F.when(role.isNull() | ~role.isin("system", "user", "assistant", "tool"), "role")
        .when(~listed(m["tools"]), "tools_json")
        .when(~listed(m["tool_calls"]), "tool_calls_json")
        .when(~blank(m["tools"]) & (role != "system"), "tools_role")
        .when(~blank(m["tool_calls"]) & (role != "assistant"), "tool_calls_role")
        .when(~blank(m["reasoning_content"]) & (role != "assistant"), "reasoning_role")
        .when((role != "assistant") & blank(m["content"]), "empty")
        .when((role == "assistant") & blank(m["content"]) & blank(m["reasoning_content"]) & blank(m["tool_calls"]), "unsupervised")
    )


def turn_fault(conv: Column) -> Column:
    """The first fault of a conversation's turns, or null.

    A system message stands first only; then a user message; every turn (up to
    the next user message) has an assistant; tool calls need tools in the system
    message, each call is answered by one tool message before the assistant
    speaks again or the turn ends, and no tool message comes without a call.
    """
    calls = lambda m: F.coalesce(F.json_array_length(m["tool_calls"]), F.lit(0))
    first = F.element_at(conv, 1)
    body = F.when(first["role"] == "system", F.slice(conv, 2, F.greatest(F.size(conv), F.lit(1)))).otherwise(conv)
    tools = F.coalesce((first["role"] == "system") & (F.coalesce(F.json_array_length(first["tools"]), F.lit(0)) > 0), F.lit(False))
    state = lambda pending, heads, fault: F.struct(pending.cast("int").alias("pending"), heads.cast("int").alias("heads"), fault.cast("string").alias("fault"))
    start = state(F.lit(0), F.lit(-1), F.lit(None))
    ended = lambda acc: F.when(acc["heads"] == 0, "no_assistant").when(acc["pending"] > 0, "unclosed_call")

    def step(acc: Column, m: Column) -> Column:
        role = m["role"]
        fault = (
            F.when(role == "user", ended(acc))
            .when((role == "assistant") & (acc["pending"] > 0), "open_call")
            .when((role == "assistant") & (calls(m) > 0) & ~tools, "no_tools")
            .when((role == "tool") & (acc["pending"] <= 0), "orphan_tool")
        )
        pending = F.when(role == "user", 0).when(role == "assistant", calls(m)).when(role == "tool", acc["pending"] - 1).otherwise(acc["pending"])
        heads = F.when(role == "user", 0).when(role == "assistant", acc["heads"] + 1).otherwise(acc["heads"])
        return state(pending, heads, F.coalesce(acc["fault"], fault))

    walked = F.aggregate(body, start, step, lambda acc: F.coalesce(acc["fault"], ended(acc)))
    return (
        F.when(conv.isNull() | (F.size(conv) == 0), "empty")
        .when(F.exists(body, lambda m: m["role"] == "system"), "system_position")
        .when((F.size(body) == 0) | (F.element_at(F.transform(body, lambda m: m["role"]), 1) != "user"), "starts_without_user")
        .otherwise(walked)
    )
