"""Chat history: messages keyed by (user_id, session_id, turn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import sizing
from corpusloom.functions.models import ChatModel
from corpusloom.operators.ranking import top_k

SESSION = ["user_id", "session_id"]

# Compaction limits and transcript labels.
KEEP_UP_TO = 50
SUMMARISE = 40
USER_LABEL = "用户: "
AI_LABEL = "AI: "
SUMMARY_LABEL = "之前的对话摘要：\n"
KNOWN_TYPES = ["human", "ai", "system"]
LIMIT_MESSAGE = (
    "TOOL_CALL_LIMIT_REACHED: search_knowledge_base has already been called once in this turn. "
    "Use the existing retrieval result and provide the final answer directly."
)


def load(messages: DataFrame) -> DataFrame:
    """Messages of known types; others are dropped."""
    return messages.filter(F.col("type").isin(KNOWN_TYPES))


def summaries(messages: DataFrame) -> DataFrame:
    """(user_id, session_id, updated_at, message_count) per session."""
    return messages.groupBy(*SESSION).agg(F.max("timestamp").alias("updated_at"), F.count("*").alias("message_count"))


def latest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), *SESSION)


def last_message(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*SESSION).agg(F.max_by("content", "turn").alias("content"))


def label(kind: Column) -> Column:
    return F.when(kind == "human", USER_LABEL).otherwise(AI_LABEL)


SUMMARY_ASKED = "把下面的聊天记录压缩成一段简短的备忘，写明谁在说话、谈了什么、还有哪些事没有做完：\n\n"
SUMMARY_END = "\n\n备忘：\n"


def transcript(messages: DataFrame) -> DataFrame:
    """One text per session, a labelled line per message. Bound the messages per session first."""
    lines = F.array_sort(
        F.collect_list(F.struct("turn", F.concat(label(F.col("type")), F.col("content")).alias("line")))
    )
    return messages.groupBy(*SESSION).agg(F.array_join(F.transform(lines, lambda m: m["line"]), "\n").alias("transcript"))


def summary_prompt(text: Column) -> Column:
    return F.concat(F.lit(SUMMARY_ASKED), text, F.lit(SUMMARY_END))


def compact(messages: DataFrame, chat: ChatModel, limit: int = KEEP_UP_TO, head: int = SUMMARISE) -> DataFrame:
    """Sessions longer than ``limit`` get their first ``head`` messages replaced by one summary.

    Session sizes come from a plain count, and the head of a session is a map-side-cut top-k, so a
    session of any length is never gathered in one task.
    """
    sizes = messages.groupBy(*SESSION).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*SESSION)
    long = sizing.lookup_join(messages, sizes, SESSION, "left_semi", ["turn"])
    first = top_k(long, SESSION, [F.asc("turn")], head, "_at").drop("_at")
    summary = transcript(first).select(
        *SESSION,
        F.lit(-1).cast("long").alias("turn"),
        F.lit("system").alias("type"),
        F.concat(F.lit(SUMMARY_LABEL), chat.reply(summary_prompt(F.col("transcript")))).alias("content"),
        F.lit(None).cast("string").alias("timestamp"),
    )
    rest = messages.join(first.select(*SESSION, "turn"), [*SESSION, "turn"], "left_anti")
    columns = [*SESSION, "turn", "type", "content", "timestamp"]
    return rest.select(*columns).unionByName(summary.select(*columns))


def guard_calls(calls: DataFrame, order: str = "call_no") -> DataFrame:
    """Mark the first tool call of a turn as allowed; later ones get the limit message."""
    first = calls.groupBy(*SESSION, "turn").agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    marked = calls.join(first, [*SESSION, "turn", order], "left").withColumn("allowed", F.col("_first").isNotNull())
    return marked.withColumn("reply", F.when(~F.col("allowed"), LIMIT_MESSAGE)).drop("_first")
