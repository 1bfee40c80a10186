"""States of refresh tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.operators.names import unused


def states(tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """tokens (id, user_id, revoked_at, expires_at) with state: revoked, expired, inactive_user or valid, in this order."""
    joined = tokens.join(users.select(F.col("id").alias("user_id"), "status"), "user_id", "left")
    state = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") < now, "expired").when(F.coalesce("status", F.lit(0)) != 1, "inactive_user").otherwise("valid")
    return joined.select(*tokens.columns, state.alias("state"))


def revoked_of(tokens: DataFrame, user_ids: DataFrame, now: Column) -> DataFrame:
    """tokens in which the live ones of user_ids are revoked now."""
    mark = unused(tokens, "hit")
    hit = tokens.join(user_ids.select("user_id").distinct().withColumn(mark, F.lit(True)), "user_id", "left")
    return hit.select(*[F.when(F.col(mark) & F.col("revoked_at").isNull(), now).otherwise(F.col(c)).alias(c) if c == "revoked_at" else c for c in tokens.columns])


def asked(requests: DataFrame, tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """requests (token_hash, …) with the state of the token with that hash, missing where there is none; of several with one hash the one with the smallest id counts."""
    known = states(tokens, users, now).groupBy("token_hash").agg(F.min_by("state", "id").alias("state"))
    return requests.join(known, "token_hash", "left").select(*[requests[c] for c in requests.columns], F.coalesce("state", F.lit("missing")).alias("state"))


def rotated(tokens: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """tokens (id, user_id, revoked_at) after those used (id, new_id) are exchanged: each is revoked now, and a live one with the new id takes its place."""
    joined = tokens.join(used, "id", "left")
    old = joined.select("id", "user_id", F.when(F.col("new_id").isNotNull(), now).otherwise(F.col("revoked_at")).alias("revoked_at"))
    new = joined.where("new_id is not null").select(F.col("new_id").alias("id"), "user_id", F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    return old.unionByName(new)


def eligible(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """attempts (email, …) with outcome unknown, inactive or ok; emails are compared letter by letter, and of several users with one email an active one counts."""
    known = users.groupBy("email").agg(F.max(F.when(F.col("status") == 1, 1).otherwise(0)).alias("status"))
    return attempts.join(known, "email", "left").select(*[attempts[c] for c in attempts.columns], F.when(F.col("status").isNull(), "unknown").when(F.col("status") != 1, "inactive").otherwise("ok").alias("outcome"))
