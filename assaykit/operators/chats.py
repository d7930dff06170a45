"""Order of roles, empty turns and tool calls in conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import redacted
from ..functions.records import CHATS
from ..functions.text import is_blank, strip
from .shared import exploded, first_n, issue

UNCAPPED = ("bad_tool_calls_type", "bad_tool_call_object", "bad_tool_response")


def chats(records: DataFrame) -> DataFrame:
    return records.where(F.col("fmt").isin(*CHATS)).withColumn("roles", F.transform("messages", lambda m: m["role"]))


def issues(records: DataFrame) -> DataFrame:
    """file, idx, line, ord, roles, severity, code, message, counted (the name under which it is counted)."""
    talk = chats(records)
    roles, size = F.col("roles"), F.size("roles")
    turns = F.filter(roles, lambda r: ~r.isin("system", "tool"))
    same = F.filter(
        F.transform(F.sequence(F.lit(2), F.size("turns")), lambda i: F.when(F.element_at("turns", i.cast("int")) == F.element_at("turns", (i - 1).cast("int")), F.element_at("turns", i.cast("int")))),
        lambda r: r.isin("user", "assistant"),
    )
    talk = talk.withColumn("turns", turns).withColumn("same", F.when(F.size("turns") > 1, F.get(same, F.lit(0))))

    def of(m, i):
        n = lambda s: F.concat(F.lit(s), i.cast("string"), F.lit("]"))
        calls = F.when(m["calls"] == "other", F.array(issue("CRITICAL", "bad_tool_calls_type", "tool_calls must be a list"))).when(
            m["bad_calls"] > 0, F.array_repeat(issue("WARNING", "bad_tool_call_object", "a tool call has no id or type"), m["bad_calls"])
        )
        none = F.array().cast("array<struct<severity:string,code:string,message:string,sample:string>>")
        return F.concat(
            F.when((m["role"] == "assistant") & is_blank(m["content"]) & ~m["excused"], F.array(issue("CRITICAL", "empty_assistant_turn", n("Empty assistant turn at messages[")))).otherwise(none),
            F.coalesce(calls, none),
            F.when((m["role"] == "tool") & ~m["answers"], F.array(issue("WARNING", "bad_tool_response", "a tool's answer has no tool_call_id or name"))).otherwise(none),
        )

    record = F.array(
        F.when((size > 1) & F.array_contains(F.slice(roles, 2, F.greatest(size, F.lit(1))), "system"), issue("CRITICAL", "system_not_at_start", "System message appears after first turn")),
        F.when(F.col("same").isNotNull(), issue("CRITICAL", "role_alternation", F.concat(F.lit("Two "), F.col("same"), F.lit(" turns in a row")))),
        F.when((size > 0) & (F.element_at(roles, -1) != "assistant"), issue("WARNING", "does_not_end_assistant", "Conversation does not end on assistant")),
    )
    found = exploded(talk, F.concat(record, F.flatten(F.transform("messages", of))), "roles", "same")
    return found.withColumn("counted", F.when(F.col("code") == "role_alternation", F.concat(F.lit("same_role_consecutive_"), F.col("same"))).otherwise(F.col("code"))).drop("same")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("file", "counted").agg(F.count("*").alias("n"))


def system_prompts(records: DataFrame) -> DataFrame:
    """file, prompt, n, first: how many conversations begin with each system prompt; those without one count as empty."""
    head = F.get("messages", F.lit(0))
    prompt = F.when(head["role"] == "system", strip(head["content"])).otherwise("")
    return chats(records).groupBy("file", F.coalesce(prompt, F.lit("")).alias("prompt")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))


def top_system_prompts(records: DataFrame, n: int) -> DataFrame:
    top = first_n(system_prompts(records), n, ["file"], F.desc("n"), F.asc("first"))
    return top.withColumn("excerpt", redacted(F.left("prompt", F.lit(300))))
