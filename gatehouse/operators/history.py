"""A user's conversations: own lists, merges of local and remote ones, retries and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.operators.names import unused


def own(conversations: DataFrame, user_id: int, app_id: int | None = None, limit: int = 20, most: int = 100) -> DataFrame:
    """(id, app_id, last_seq, place): the user's live conversations, the latest first, of one app where given; limit is within 1 and most."""
    found = conversations.where((F.col("user_id") == user_id) & ~F.col("deleted"))
    found = found if app_id is None else found.where(F.col("app_id") == app_id)
    top = found.orderBy(F.desc("last_seq"), F.desc("id")).limit(min(max(limit, 1), most))
    # At most `most` rows are numbered.
    return top.select("id", "app_id", "last_seq", F.row_number().over(Window.orderBy(F.desc("last_seq"), F.desc("id"))).alias("place"))


def guarded(asked: DataFrame, conversations: DataFrame) -> DataFrame:
    """asked (conversation_id, user_id, app_id, …) with outcome ok, or not_found where there is no such conversation, it is deleted, or it belongs to another user or app: a reader can't tell these apart."""
    found = unused(asked, "found")
    live = conversations.where(~F.col("deleted")).select(F.col("id").alias("conversation_id"), "user_id", "app_id", F.lit("ok").alias(found))
    joined = asked.join(live, ["conversation_id", "user_id", "app_id"], "left")
    return joined.select(*[asked[c] for c in asked.columns], F.coalesce(found, F.lit("not_found")).alias("outcome"))


def retried(messages: DataFrame) -> DataFrame:
    """(conversation_id, retried, kept) of messages (…, failed): the last question, which a retry asks again, and how many messages stay when failed ones go. Conversations without a question give no row."""
    asked = F.when(F.col("role") == "user", F.col("seq"))
    folded = messages.groupBy("conversation_id").agg(F.max_by("content", asked).alias("retried"), F.count_if(~F.col("failed")).alias("kept"))
    return folded.where("retried is not null")


def merged(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """The columns of remote, and source: local rows whose key isn't among the remote ones (source 0) before all remote rows (source 1), which win."""
    only = local.join(remote.select(key), key, "left_anti")
    return only.select(*remote.columns, F.lit(0).alias("source")).unionByName(remote.withColumn("source", F.lit(1)))


def to_front(rows: DataFrame, one: DataFrame, key: str = "id") -> DataFrame:
    """rows with one's row in place of the row with its key, and front: 0 for it, 1 for the others; one is a single row."""
    others = rows.join(F.broadcast(one.select(key)), key, "left_anti")
    return one.select(*rows.columns, F.lit(0).alias("front")).unionByName(others.withColumn("front", F.lit(1)))


def with_names(rows: DataFrame, key: str, known: DataFrame, name: str) -> DataFrame:
    """rows with name: the name of its key in known (id, name), the key itself where it isn't known, a dash where there is none."""
    told = unused(rows, "told")
    names = known.select(F.col("id").alias(key), F.col("name").alias(told))
    return rows.join(names, key, "left").select(*[rows[c] for c in rows.columns], F.coalesce(told, F.col(key).cast("string"), F.lit("—")).alias(name))


def exported(messages: DataFrame) -> DataFrame:
    """(conversation_id, json): each conversation's messages in order as a JSON array."""
    own = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    return messages.groupBy("conversation_id").agg(F.to_json(own).alias("json"))


def flushed(deltas: DataFrame, at: str, text: str, milliseconds: int = 80) -> DataFrame:
    """(stream_id, flush, text): deltas (stream_id, seq, …) that come within one interval as one text, in order."""
    flush = F.floor(F.col(at) / milliseconds).alias("flush")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("seq", F.col(text).alias("x")))).getField("x"), "")
    return deltas.groupBy("stream_id", flush).agg(joined.alias("text"))
