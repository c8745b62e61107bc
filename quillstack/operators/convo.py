"""Conversations: titles, histories, state as JSON, and edits of nested state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as t

MESSAGE = "struct<id:string,role:string,content:string,createdAt:string>"
BUBBLE = "struct<id:string,query:string,topK:int,fileNames:array<string>,response:string,error:string>"
STATE = f"struct<conversations:array<struct<id:string,title:string,messages:array<{MESSAGE}>,bubbles:array<{BUBBLE}>,createdAt:string,updatedAt:string>>,activeConversationId:string>"


def folded(messages: DataFrame) -> DataFrame:
    """One row per conversation: ordered messages, first question, last answer, counts."""
    order = F.struct("turn", "role", "text")
    m = messages.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", order)).alias("first_question"),
        F.max_by(F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.col("text")), F.when((F.col("role") == "assistant") & (F.col("text") != ""), order)).alias("last_answer"),
        F.count("*").alias("n_messages"),
        F.sum(F.length("text")).alias("n_chars"),
    )
    return m


def titles(messages: DataFrame) -> DataFrame:
    """A title for each conversation; the fallback names its id where the first question leaves nothing."""
    one = folded(messages)
    made = t.title(F.coalesce("first_question", F.lit("")))
    return one.select("conv_id", F.when(made == "", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))).otherwise(made).alias("title"))


def timestamp_title(ts: Column) -> Column:
    return F.date_format(ts, "M'月'd'日' HH:mm")


def history(conversations: DataFrame, active: int | None) -> DataFrame:
    """All but the active one, newest first."""
    rows = conversations if active is None else conversations.where(F.col("conv_id") != active)
    return rows.orderBy(F.desc("conv_id"))


def load_state(blobs: DataFrame) -> DataFrame:
    """State of JSON blobs (id, value): missing bubbles become empty, damaged JSON an empty state."""
    state = F.from_json("value", STATE)
    talks = F.transform(state["conversations"], lambda c: c.withField("bubbles", F.coalesce(c["bubbles"], F.array().cast(f"array<{BUBBLE}>"))))
    empty = F.from_json(F.lit('{"conversations":[]}'), STATE)
    whole = state.withField("conversations", talks)
    return blobs.select("id", F.when(state["conversations"].isNull(), empty).otherwise(whole).alias("state"))


def save_state(states: DataFrame) -> DataFrame:
    return states.select("id", F.to_json("state").alias("value"))


def renamed(states: DataFrame, conversation: str, title: str) -> DataFrame:
    """A blank title changes nothing."""
    name = title.strip()
    if not name:
        return states
    talks = F.transform("state.conversations", lambda c: F.when(c["id"] == conversation, c.withField("title", F.lit(name))).otherwise(c))
    return states.withColumn("state", F.col("state").withField("conversations", talks))


def deleted(states: DataFrame, conversation: str) -> DataFrame:
    """Without a conversation; if it was active, none is."""
    rest = F.filter("state.conversations", lambda c: c["id"] != conversation)
    now = F.col("state.activeConversationId")
    return states.withColumn("state", F.col("state").withField("conversations", rest).withField("activeConversationId", F.when(now != conversation, now)))


def _edited(states: DataFrame, conversation: str, change) -> DataFrame:
    talks = F.transform("state.conversations", lambda c: F.when(c["id"] == conversation, change(c)).otherwise(c))
    return states.withColumn("state", F.col("state").withField("conversations", talks))


def added(states: DataFrame, conversation: str, title: str, at: str) -> DataFrame:
    """A new conversation at the head, which becomes the active one."""
    kind = STATE[STATE.index("array<struct<id") + len("array<") : STATE.index(">>,activeConversationId") + 1]
    new = F.from_json(F.to_json(F.struct(F.lit(conversation).alias("id"), F.lit(title).alias("title"), F.lit(at).alias("createdAt"), F.lit(at).alias("updatedAt"))), kind)
    new = new.withField("messages", F.array().cast(f"array<{MESSAGE}>")).withField("bubbles", F.array().cast(f"array<{BUBBLE}>"))
    state = F.col("state").withField("conversations", F.concat(F.array(new), F.col("state.conversations")))
    return states.withColumn("state", state.withField("activeConversationId", F.lit(conversation)))


def activated(states: DataFrame, conversation: str | None) -> DataFrame:
    return states.withColumn("state", F.col("state").withField("activeConversationId", F.lit(conversation).cast("string")))


def bubble_added(states: DataFrame, conversation: str, bubble: str, query: str, k: int) -> DataFrame:
    new = F.from_json(F.to_json(F.struct(F.lit(bubble).alias("id"), F.lit(query).alias("query"), F.lit(k).alias("topK"))), BUBBLE)
    return _edited(states, conversation, lambda c: c.withField("bubbles", F.concat(c["bubbles"], F.array(new))))


def bubble_answered(states: DataFrame, conversation: str, bubble: str, response: str | None, error: str | None) -> DataFrame:
    def change(b: Column) -> Column:
        return F.when(b["id"] == bubble, b.withField("response", F.lit(response).cast("string")).withField("error", F.lit(error).cast("string"))).otherwise(b)

    return _edited(states, conversation, lambda c: c.withField("bubbles", F.transform(c["bubbles"], change)))


def bubbles_cleared(states: DataFrame, conversation: str) -> DataFrame:
    return _edited(states, conversation, lambda c: c.withField("bubbles", F.array().cast(f"array<{BUBBLE}>")))


def content_text(parts: Column, whole: Column) -> Column:
    """Text of a message: the string itself, or its parts' texts joined by newlines."""
    return F.coalesce(whole, F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.to_json(p))), "\n"))


DISABLED = "Chat generation is disabled"  # fixed value: the error that means no model was asked


def is_degraded(answer: Column, error: Column) -> Column:
    """An error other than that of a disabled model, and no answer."""
    return error.isNotNull() & (error != DISABLED) & (F.coalesce(answer, F.lit("")) == "")
