"""Conversation histories: messages (thread_id, turn, role, content), and checkpoints (thread_id, seq, ts, source, messages)
whose messages are an array of (role, content, has_tool_calls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The preview of a thread without one, and the date of a session whose time can't be read.
NO_PREVIEW, NO_DATE = "新对话", "未知日期"
#: Kinds of messages that are shown, and as whose.
ROLES = {"HumanMessage": "user", "human": "user", "user": "user", "AIMessage": "assistant", "AIMessageChunk": "assistant", "ai": "assistant", "assistant": "assistant"}


def append_messages(history: DataFrame, new: DataFrame) -> DataFrame:
    """new (thread_id, ord, role, content) after the last turn of its thread, in order."""
    last = history.groupBy("thread_id").agg(F.max("turn").alias("last"))
    at = F.row_number().over(Window.partitionBy("thread_id").orderBy("ord"))
    added = new.withColumn("at", at).join(last, "thread_id", "left").select("thread_id", (F.coalesce("last", F.lit(-1)) + F.col("at")).cast("long").alias("turn"), "role", "content")
    return history.select("thread_id", F.col("turn").cast("long").alias("turn"), "role", "content").union(added)


def clear_session(history: DataFrame, threads: DataFrame) -> DataFrame:
    return history.join(threads.select("thread_id").distinct(), "thread_id", "left_anti")


def user_threads(history: DataFrame, user: str) -> DataFrame:
    return history.where((F.col("thread_id") == user) | F.col("thread_id").startswith(f"{user}_"))


def first_input_per_thread(checkpoints: DataFrame, shown: int = 100) -> DataFrame:
    """(thread_id, created_at, preview) of each thread's first checkpoint of source input: its time, and the head of its first
    message, or a fixed text where that is empty."""
    first = checkpoints.where(F.col("source") == "input").groupBy("thread_id").agg(F.min_by(F.struct("ts", F.get("messages", F.lit(0))["content"].alias("content")), "seq").alias("c"))
    preview = F.coalesce(F.nullif(F.substring("c.content", 1, shown), F.lit("")), F.lit(NO_PREVIEW))
    return first.select("thread_id", F.col("c.ts").alias("created_at"), preview.alias("preview"))


#: A time as ISO 8601 writes it: a calendar date alone, or with a time of at least hours, and that with a fraction and an offset; with signs
#: between the parts or without.
_OFFSET = r"(?:[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?)?"
_ISO = (
    r"^(\d{4})-(\d{2})-(\d{2})(?:[\s\S]([01]\d|2[0-3])(?::([0-5]\d)(?::[0-5]\d(?:[.,]\d+)?)?)?" + _OFFSET + r")?$",
    r"^(\d{4})(\d{2})(\d{2})(?:[\s\S]([01]\d|2[0-3])(?::?([0-5]\d)(?::?[0-5]\d(?:[.,]\d+)?)?)?" + _OFFSET + r")?$",
)


def sessions_by_date(sessions: DataFrame) -> DataFrame:
    """sessions (thread_id, created_at, preview) with date and time (HH:MM), the latest date first and in it the latest
    session, by the text of created_at. Date and time are those that the text says, whatever its offset or the session's time zone. A text that
    is no whole date of the calendar, or has a time that is none, is of an unknown date, which goes before all others."""
    text = F.replace(F.col("created_at").cast("string"), F.lit("Z"), F.lit("+00:00"))
    iso = F.coalesce(*[F.when(text.rlike(x), F.array(*[F.regexp_extract(text, x, i) for i in range(1, 6)])) for x in _ISO])
    day = F.concat_ws("-", *[F.col("iso")[i] for i in range(3)])
    real = F.col("iso").isNotNull() & (F.col("iso")[0] != "0000") & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    clock = F.concat(F.when(F.col("iso")[3] == "", "00").otherwise(F.col("iso")[3]), F.lit(":"), F.when(F.col("iso")[4] == "", "00").otherwise(F.col("iso")[4]))
    dated = sessions.withColumn("iso", iso).select(F.when(real, day).otherwise(NO_DATE).alias("date"), F.when(real, clock).otherwise("").alias("time"), "thread_id", "created_at", "preview")
    return dated.orderBy(F.col("date").desc(), F.col("created_at").desc(), "thread_id")


def _latest(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("thread_id").agg(F.max_by("messages", "seq").alias("messages"))


def _shown_as(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return known[role]


def session_messages(checkpoints: DataFrame) -> DataFrame:
    """(thread_id, at, role, content): the messages of users and assistants with content in each thread's latest checkpoint, numbered
    from 1."""
    shown = F.transform("messages", lambda m: F.struct(_shown_as(m["role"]).alias("role"), m["content"].alias("content")))
    kept = F.filter(shown, lambda m: m["role"].isNotNull() & (F.coalesce(m["content"], F.lit("")) != ""))
    rows = _latest(checkpoints).select("thread_id", F.posexplode(kept).alias("at", "m"))
    return rows.select("thread_id", (F.col("at") + 1).cast("long").alias("at"), "m.role", "m.content")


def pending_tool_calls(checkpoints: DataFrame) -> DataFrame:
    """(thread_id) of the threads whose latest checkpoint ends in a message of an assistant with tool calls: nothing has answered them."""
    last = F.element_at("messages", -1)
    ends = _latest(checkpoints).where(F.size("messages") > 0).select("thread_id", last.alias("m"))
    return ends.where((_shown_as(F.col("m.role")) == "assistant") & F.coalesce("m.has_tool_calls", F.lit(False))).select("thread_id")
