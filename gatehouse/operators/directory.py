"""The organisation's directory: search, pages, and the department tree by materialized paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.operators import hierarchy, ordering
from gatehouse.operators.names import unused


def filtered(users: DataFrame, query: str | None = None, status: int | None = None, dept_id: int | None = None) -> DataFrame:
    """users whose name or email holds query, any case (% and _ are wildcards), with status and dept_id where given."""
    if query:
        users = users.where(F.col("name").ilike(f"%{query}%") | F.col("email").ilike(f"%{query}%"))
    if status is not None:
        users = users.where(F.col("status") == status)
    return users if dept_id is None else users.where(F.col("dept_id") == dept_id)


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """One page of rows in an order that must be total; number is 1 at least, size within 1 and most."""
    size = min(max(size, 1), most)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def with_paths(departments: DataFrame) -> DataFrame:
    """departments with path, "/1/3/7/", from parent_id, of any depth; those on or below a cycle, or below a missing parent, have none."""
    return hierarchy.paths(departments.select("id", "name", "parent_id"))


def ancestors(paths: DataFrame) -> DataFrame:
    """(id, ancestor_id) for each department and every department above it and itself: descendants by an equi-join, not by a prefix match of all with all."""
    return paths.select("id", F.explode(F.split(F.expr("substring(path, 2, length(path) - 2)"), "/")).alias("a")).select("id", F.col("a").cast("long").alias("ancestor_id"))


def subtree(paths: DataFrame, root: str) -> DataFrame:
    """The department whose path is root, and all below it."""
    return paths.where(F.col("path").startswith(root))


def moved(paths: DataFrame, id_: int, new_parent: int | None) -> DataFrame:
    """paths after department id_ goes below new_parent (None: becomes a root), with outcome moved, not_found, self_parent, unknown_parent or cycle, in this order, on every row; a refused move changes nothing."""
    # One row: at most one path each, by primary key.
    facts = paths.agg(F.max(F.when(F.col("id") == id_, F.col("path"))).alias("old"), F.max(F.when(F.col("id") == F.lit(new_parent), F.col("path"))).alias("above"))
    above = F.lit("/") if new_parent is None else F.col("above")
    outcome = F.when(F.col("old").isNull(), "not_found").when(F.lit(new_parent == id_), "self_parent").when(above.isNull(), "unknown_parent").when(above.contains(f"/{id_}/"), "cycle").otherwise("moved")
    joined = paths.join(F.broadcast(facts.select("old", above.alias("above"), outcome.alias("outcome"))), how="cross")
    hit = (F.col("outcome") == "moved") & F.col("path").startswith(F.col("old"))
    path = F.when(hit, F.concat("above", F.lit(f"{id_}/"), F.expr("substring(path, length(old) + 1)"))).otherwise(F.col("path"))
    above_id = F.when(hit & (F.col("id") == id_), F.lit(new_parent).cast("long")).otherwise(F.col("parent_id"))
    return joined.select("id", "name", above_id.alias("parent_id"), path.alias("path"), "outcome")


def deleted(departments: DataFrame, users: DataFrame, grants: DataFrame, id_: int) -> tuple[DataFrame, DataFrame]:
    """(departments, grants) without department id_ and its grants, if the guard lets it go; else both as they are."""
    gone = delete_guard(departments, users).where((F.col("id") == id_) & (F.col("outcome") == "ok")).select("id")
    left = grants.join(F.broadcast(gone.select(F.lit("dept").alias("principal_type"), F.col("id").alias("principal_id"))), ["principal_type", "principal_id"], "left_anti")
    return departments.join(F.broadcast(gone), "id", "left_anti"), left


def after(rows: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next batch of rows by a unique key, behind the last one seen (None: from the beginning): each batch reads on from where the other ended."""
    return (rows if last is None else rows.where(F.col(key) > last)).orderBy(key).limit(size)


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with batch, from 0: all batches that a reader gets who asks for the next `size` rows by a unique key until there are none (after)."""
    own = ordering.placed(rows, [F.col(key)], unused(rows, "place"))
    return own.select(*rows.columns, F.floor((F.col(own.columns[-1]) - 1) / size).cast("long").alias("batch"))


def delete_guard(departments: DataFrame, users: DataFrame) -> DataFrame:
    """(id, outcome): has_children, has_users or ok, in this order."""
    below = departments.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("children", F.lit(True))
    held = users.where("dept_id is not null").select(F.col("dept_id").alias("id")).distinct().withColumn("users", F.lit(True))
    joined = departments.select("id").join(below, "id", "left").join(held, "id", "left")
    return joined.select("id", F.when(F.col("children"), "has_children").when(F.col("users"), "has_users").otherwise("ok").alias("outcome"))
