"""Conversations, messages and feedback as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.ordered import number_rows

DEFAULT_TITLE = "New conversation"
DOCK_KIND = "demo_dock"
DOCK_TITLE = "Assistant"
PAGE = 200

TRACE_EVENTS = (
    "array<struct<kind:string,callId:string,name:string,args:string,output:string,text:string>>"
)


def conversation_list(heads: DataFrame, user: Column | None = None) -> DataFrame:
    """Conversations, last updated first, of one user or of all."""
    rows = heads if user is None else heads.where(F.col("user_email") == user)
    return rows.orderBy("user_email", F.desc("updated_at"), "conversation_id")


def append_positions(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Positions for new messages: each conversation goes on after its highest position, from 0
    when it is new. ``order`` is a whole number that orders the new messages."""
    last = existing.groupBy("conversation_id").agg((F.max("position") + 1).alias("start"))
    paged = new.withColumn("_page", F.floor(F.col(order) / PAGE))
    numbered = number_rows(paged, ["conversation_id"], "_page", [order], "position", last)
    return numbered.withColumn("position", (F.col("position") - 1).cast("bigint")).drop("_page")


def with_messages(heads: DataFrame, messages: DataFrame, page: int = PAGE) -> DataFrame:
    """Conversations with their messages nested in order, in pages of bounded length: one row
    per conversation and page, however long the conversation."""
    pages = (
        messages.groupBy("conversation_id", F.floor(F.col("position") / page).alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "role", "content"))).alias("messages"))
    )
    return heads.join(pages, "conversation_id")


def dock_id(user: Column) -> Column:
    """-1 less the first 60 bits of the name's MD5 digest."""
    return F.lit(-1).cast("bigint") - F.conv(F.substring(F.md5(user.cast("binary")), 1, 15), 16, 10).cast("bigint")


def get_or_create_dock(heads: DataFrame, users: DataFrame) -> DataFrame:
    """One dock conversation per user: the existing one with the smallest id, else a new row. Its id
    comes from the user's name, so a repeated run makes the same row; it is negative, so it never
    meets a given id."""
    docks = heads.where(F.col("kind") == DOCK_KIND).groupBy("user_email").agg(
        F.min("conversation_id").alias("conversation_id")
    )
    missing = users.select("user_email").distinct().join(docks, "user_email", "left_anti")
    existing = docks.join(heads.select("conversation_id", "title"), "conversation_id").select(
        "user_email", "conversation_id", "title", F.lit(False).alias("created")
    )
    created = missing.select(
        "user_email", dock_id(F.col("user_email")).alias("conversation_id"),
        F.lit(DOCK_TITLE).alias("title"), F.lit(True).alias("created"),
    )
    return existing.join(users.select("user_email").distinct(), "user_email", "left_semi").unionByName(created)


def cascade_delete(
    requests: DataFrame, heads: DataFrame, messages: DataFrame, feedback: DataFrame
) -> dict[str, DataFrame]:
    """Delete the requested conversations (user and id must both match) with all that hangs on
    them."""
    gone = heads.join(requests, ["user_email", "conversation_id"], "left_semi").select("conversation_id")
    tables = {"conversations": heads, "messages": messages, "feedback": feedback}
    return {name: df.join(gone, "conversation_id", "left_anti") for name, df in tables.items()}


def rename_if_default(heads: DataFrame, title: Column) -> DataFrame:
    fresh = F.col("title") == DEFAULT_TITLE
    return heads.withColumn("title", F.when(fresh, title).otherwise(F.col("title")))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return (
        feedback.groupBy("conversation_id")
        .pivot("value", ["up", "down"])
        .agg(F.count(F.lit(1)))
        .fillna(0, ["up", "down"])
    )


def tool_trace(traces: DataFrame) -> DataFrame:
    """Tool calls with their outputs. Call and output share an id within a message, so they meet
    in one aggregate rather than a self-join."""
    events = F.explode(F.from_json("thinking", TRACE_EVENTS)).alias("e")
    kind = F.col("kind")

    def of(wanted: str, field: str) -> Column:
        return F.max(F.when(kind == wanted, F.col(field))).alias(field)

    return (
        traces.select("conversation_id", "position", events)
        .select("conversation_id", "position", "e.*")
        .where(F.col("callId").isNotNull())
        .groupBy("conversation_id", "position", "callId")
        .agg(of("tool_call", "name"), of("tool_call", "args"), of("tool_output", "output"))
    )


def script_steps(messages: DataFrame, triggers: dict[int, list[str]]) -> DataFrame:
    """Script steps that an assistant message unlocks: any trigger substring, case aside."""
    text = F.lower(F.col("content"))
    steps = F.array(
        *[
            F.when(
                F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: text.contains(w)),
                F.lit(step),
            )
            for step, words in triggers.items()
        ]
    )
    return messages.where(F.col("role") == "assistant").select(
        "conversation_id", "position", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("step")
    )
