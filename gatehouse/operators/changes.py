"""Tables after a change: each function takes the old table and the change and returns the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.operators.names import unused


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows, which may lack columns (null then)."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def combined(patches: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """patches (key, fields array<string>, values…) with one row a key: each field takes its value from the last patch that names it, by order, then by a hash of the row where order is the same or not given."""
    values = [c for c in patches.columns if c not in (key, "fields", order)]
    at = F.struct(*([order] if order else []), F.xxhash64(*patches.columns))
    named = lambda c: F.array_contains("fields", c)
    last = [F.max_by(F.struct(F.col(c).alias("x")), F.when(named(c), at)).getField("x").alias(c) for c in values]
    return patches.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("fields"))).alias("fields"), *last)


def patched(table: DataFrame, patches: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """table with the fields that patches (key, fields array<string>, values…) names: a named one takes its value, null too; one that isn't named stays, whatever its value. Several patches of a key count as one (combined)."""
    own = combined(patches, key, order)
    values = [c for c in own.columns if c not in (key, "fields")]
    new, names = unused(table, "patch"), unused(table, "named")
    joined = table.join(own.select(key, F.col("fields").alias(names), F.struct(*values).alias(new)), key, "left")
    named = lambda c: F.coalesce(F.array_contains(names, c), F.lit(False))
    return joined.select(*[F.when(named(c), F.col(f"{new}.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def seeded(table: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """table with those defaults whose key it lacks; running it again changes nothing."""
    return appended(table, defaults.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def backfilled(table: DataFrame, late: DataFrame, key: str, order: str) -> DataFrame:
    """table with late rows, one a dedupe key, the earliest by order; a key that the table has already is left alone."""
    first = late.groupBy(key).agg(F.min_by(F.struct(*late.columns), order).alias("row")).select("row.*")
    return table.unionByName(first.join(table.select(key), key, "left_anti").select(*table.columns))


def audit_rows(changes: DataFrame, action: str, detail: list[str] | None = None) -> DataFrame:
    """(resource_id, action, detail): an audit row for each change, its detail as JSON of the named columns, null without any."""
    told = F.to_json(F.struct(*detail)) if detail else F.lit(None).cast("string")
    return changes.select("resource_id", F.lit(action).alias("action"), told.alias("detail"))


def roles_from_json(users: DataFrame, roles: DataFrame, default: str = "USER") -> DataFrame:
    """(user_id, code) of users (id, roles_json): each known code of the JSON array once; a user without a known one gets the default."""
    told = users.select(F.col("id").alias("user_id"), F.explode_outer(F.from_json("roles_json", "array<string>")).alias("code"))
    known = told.join(roles.select("code"), "code", "left_semi").select("user_id", "code").distinct()
    rest = users.select(F.col("id").alias("user_id")).join(known, "user_id", "left_anti").select("user_id", F.lit(default).alias("code"))
    return known.unionByName(rest)


def key_values(lines: DataFrame, prefix: str, held: DataFrame) -> DataFrame:
    """(key, value, source): key=value lines (at, line) whose key begins with prefix; comments and lines without = are skipped, the first = splits, the last line of a key counts, and a key that held (key, value) has already keeps its value."""
    line = F.trim("line")
    parts = F.split(line, "=", 2)
    told = lines.where(~line.startswith("#") & line.contains("=")).select("at", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")).where(F.col("key").startswith(prefix))
    told = told.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    fresh = told.join(held.select("key"), "key", "left_anti").withColumn("source", F.lit("file"))
    return held.select("key", "value", F.lit("held").alias("source")).unionByName(fresh)
