"""Who may see what: user, department and role grants, with an administrator's bypass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.operators import blocks

#: Fixed value: the code of the role that may do everything.
ADMIN = "PLATFORM_ADMIN"


def principals(users: DataFrame, user_roles: DataFrame) -> DataFrame:
    """(user_id, principal_type, principal_id): each user as itself, its department and its roles."""
    own = users.select(F.col("id").alias("user_id"), F.explode(F.array(F.struct(F.lit("user").alias("principal_type"), F.col("id").alias("principal_id")), F.struct(F.lit("dept").alias("principal_type"), F.col("dept_id").alias("principal_id")))).alias("p"))
    roles = user_roles.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return own.select("user_id", "p.principal_type", "p.principal_id").where("principal_id is not null").unionByName(roles.select("user_id", F.lit("role").alias("principal_type"), F.col("role_id").alias("principal_id")))


def admin_ids(users: DataFrame, user_roles: DataFrame, roles: DataFrame, code: str = ADMIN) -> DataFrame:
    """(user_id) of users among whose effective roles is that one, asked live: by a role row or, for users without any, by the JSON array in roles_json, where users has that column."""
    by_row = user_roles.join(roles.where(F.col("code") == code).select(F.col("id").alias("role_id")), "role_id", "left_semi").select("user_id")
    own = by_row.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi").distinct()
    if "roles_json" not in users.columns:
        return own
    told = users.where(F.array_contains(F.from_json("roles_json", "array<string>"), code)).select(F.col("id").alias("user_id"))
    known = user_roles.join(roles.select(F.col("id").alias("role_id")), "role_id", "left_semi").select("user_id")
    return own.unionByName(told.join(known, "user_id", "left_anti").distinct())


def _kinds(users: DataFrame, user_roles: DataFrame) -> DataFrame:
    """(user_id, kind): the principals that a user shares with others, its department and roles, sorted: users of one kind see the same by grants that aren't their own. Users without any have no row."""
    shared = principals(users, user_roles).where("principal_type <> 'user'")
    return shared.groupBy("user_id").agg(F.array_sort(F.collect_set(F.struct("principal_type", "principal_id"))).alias("kind"))


def _open(resources: DataFrame) -> DataFrame:
    return resources.where("status = 1").select(F.col("id").alias("resource_id"))


def _by_grants(users: DataFrame, user_roles: DataFrame, grants: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What users see by grants of active resources, never as all pairs: (user_id, kind), (kind, resource_id) that a kind sees, each once, and (user_id, kind, resource_id) that a grant of its own adds to what a user's kind sees."""
    kinds = _kinds(users, user_roles)
    what = grants.join(_open(resources), "resource_id", "left_semi")
    held = kinds.select("kind").distinct().select("kind", F.explode("kind").alias("p")).select("kind", "p.principal_type", "p.principal_id")
    seen = held.join(what.where("principal_type <> 'user'"), ["principal_type", "principal_id"]).select("kind", "resource_id").distinct()
    own = what.where("principal_type = 'user'").select(F.col("principal_id").alias("user_id"), "resource_id").distinct()
    known = own.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi").join(kinds, "user_id", "left")
    return kinds, seen, known.join(seen, ["kind", "resource_id"], "left_anti").select("user_id", "kind", "resource_id")


def _written_out(users: DataFrame, lists: DataFrame, keys: list[str], deals: int = 16) -> DataFrame:
    """(user_id, resource_id): users (user_id, keys) with all resources of lists (keys, resource_id). Users are dealt, and lists of each deal meet lists of resources, so pairs come into being within tasks and are never shuffled."""
    dealt = blocks.lists(users.withColumn("deal", F.pmod(F.xxhash64("user_id"), F.lit(deals)).cast("int")), [*keys, "deal"], "user_id", "ones")
    chunks = blocks.lists(lists.withColumn("chunk", F.pmod(F.xxhash64("resource_id"), F.lit(8))), [*keys, "chunk"], "resource_id", "others")
    copies = chunks.select(*keys, "others", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    return blocks.written_out(dealt, copies, [*keys, "deal"], "user_id", "resource_id", [*keys, "deal"])


def scopes(users: DataFrame, user_roles: DataFrame, grants: DataFrame, resources: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, resource_id, unrestricted) of active users: a row for each active resource that a grant shows, and one row without a resource for an administrator, whom nothing restricts.

    The disjunction of three kinds of grants is one equi-join on (type, id), not of each user but of each
    kind of users (_kinds); what a kind sees is then written out for its users, and what their own grants
    add. No pair comes twice, so none is shuffled to be told apart. Department grants aren't inherited.
    """
    active = users.where("status = 1")
    admins = admin_ids(active, user_roles, roles)
    kinds, seen, added = _by_grants(active.join(admins.withColumnRenamed("user_id", "id"), "id", "left_anti"), user_roles, grants, resources)
    shared = _written_out(kinds, seen, ["kind"]).unionByName(added.select("user_id", "resource_id"))
    return shared.withColumn("unrestricted", F.lit(False)).unionByName(admins.select("user_id", F.lit(None).cast("long").alias("resource_id"), F.lit(True).alias("unrestricted")))


def visible(users: DataFrame, user_roles: DataFrame, grants: DataFrame, resources: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, resource_id) of active users and active resources: scopes with administrators written out, for those who need the pairs; who needs numbers asks reach or counted."""
    own = scopes(users, user_roles, grants, resources, roles)
    admins = admin_ids(users.where("status = 1"), user_roles, roles)
    every = _written_out(admins, _open(resources), [], 64)
    return own.where("not unrestricted").select("user_id", "resource_id").unionByName(every)


def reach(users: DataFrame, user_roles: DataFrame, grants: DataFrame, resources: DataFrame, roles: DataFrame) -> DataFrame:
    """(resource_id, n_users) of all resources: how many active users see each, none where it isn't active. Kinds are counted by their sizes, so no pair is written out."""
    active = users.where("status = 1")
    admins = admin_ids(active, user_roles, roles)
    kinds, seen, added = _by_grants(active.join(admins.withColumnRenamed("user_id", "id"), "id", "left_anti"), user_roles, grants, resources)
    by_kind = seen.join(kinds.groupBy("kind").agg(F.count("*").alias("n")), "kind").select("resource_id", "n")
    every = _open(resources).join(F.broadcast(admins.agg(F.count("*").alias("n"))), how="cross")  # one row
    seen_by = by_kind.unionByName(added.select("resource_id", F.lit(1).cast("long").alias("n"))).unionByName(every).groupBy("resource_id").agg(F.sum("n").alias("n"))
    return resources.select(F.col("id").alias("resource_id")).join(seen_by, "resource_id", "left").select("resource_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_users"))


def counted(users: DataFrame, user_roles: DataFrame, grants: DataFrame, resources: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, n_resources) of the active users who see any resource: how many active ones. An administrator sees all, so they are counted once for all of them; no pair is written out."""
    active = users.where("status = 1")
    admins = admin_ids(active, user_roles, roles)
    kinds, seen, added = _by_grants(active.join(admins.withColumnRenamed("user_id", "id"), "id", "left_anti"), user_roles, grants, resources)
    by_kind = kinds.join(seen.groupBy("kind").agg(F.count("*").alias("n")), "kind").select("user_id", "n")
    every = admins.join(F.broadcast(_open(resources).agg(F.count("*").alias("n"))), how="cross").where("n > 0")  # one row
    rows = by_kind.unionByName(added.select("user_id", F.lit(1).cast("long").alias("n"))).unionByName(every.select("user_id", "n"))
    return rows.groupBy("user_id").agg(F.sum("n").alias("n_resources"))


def closed(users: DataFrame, user_roles: DataFrame, grants: DataFrame, resources: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id) of the active users who see nothing: none of their principals has a grant of an active resource, and they are no administrators, unless there is nothing to see. Only principals are looked at, not what they see."""
    active = users.where("status = 1")
    granted = grants.join(_open(resources), "resource_id", "left_semi").select("principal_type", "principal_id").distinct()
    some = principals(active, user_roles).join(granted, ["principal_type", "principal_id"], "left_semi").select("user_id")
    admins = admin_ids(active, user_roles, roles).join(F.broadcast(_open(resources).limit(1)), how="cross")  # one row
    return active.select(F.col("id").alias("user_id")).join(some.unionByName(admins.select("user_id")), "user_id", "left_anti")


def decided(requests: DataFrame, users: DataFrame, user_roles: DataFrame, grants: DataFrame, resources: DataFrame, roles: DataFrame) -> DataFrame:
    """requests (user_id, resource_id, …) with outcome allow, deny, not_found (no such resource) or inactive (of user or resource). Closed by default.

    Only pairs that are asked for are looked at: the principals of their users are joined with the grants
    of their resources, so no product of users and resources is built; administrators are a flag.
    """
    admins = admin_ids(users, user_roles, roles).withColumn("unrestricted", F.lit(True))
    who = users.select(F.col("id").alias("user_id"), F.col("status").alias("user_status")).join(admins, "user_id", "left")
    what = resources.select(F.col("id").alias("resource_id"), F.col("status").alias("resource_status"))
    asked = requests.select("user_id", "resource_id").distinct()
    held = asked.join(principals(users.where("status = 1"), user_roles), "user_id")
    seen = held.join(grants, ["resource_id", "principal_type", "principal_id"], "left_semi").select("user_id", "resource_id").distinct().withColumn("seen", F.lit(True))
    facts = asked.join(who, "user_id", "left").join(what, "resource_id", "left").join(seen, ["user_id", "resource_id"], "left")
    outcome = F.when(F.col("resource_status").isNull(), "not_found").when((F.coalesce("user_status", F.lit(0)) != 1) | (F.col("resource_status") != 1), "inactive").when(F.col("unrestricted") | F.col("seen"), "allow").otherwise("deny")
    told = facts.select(F.col("user_id").alias("asked_user"), F.col("resource_id").alias("asked_resource"), outcome.alias("told"))
    same = requests["user_id"].eqNullSafe(told["asked_user"]) & requests["resource_id"].eqNullSafe(told["asked_resource"])
    return requests.join(told, same).select(*[requests[c] for c in requests.columns], told["told"].alias("outcome"))


def effective_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame, default: str = "USER") -> DataFrame:
    """(user_id, codes): role codes by role id; without any, the codes of the JSON array in roles_json, where users has that column, as they stand there; without those, the default one."""
    held = user_roles.join(roles.withColumnRenamed("id", "role_id"), "role_id").groupBy("user_id").agg(F.array_sort(F.collect_set(F.struct("role_id", "code"))).alias("held"))
    told = F.from_json("roles_json", "array<string>") if "roles_json" in users.columns else F.lit(None).cast("array<string>")
    joined = users.select(F.col("id").alias("user_id"), F.when(F.size(told) > 0, told).alias("told")).join(held, "user_id", "left")
    return joined.select("user_id", F.coalesce(F.col("held.code"), "told", F.array(F.lit(default))).alias("codes"))


def administrators(users: DataFrame, user_roles: DataFrame, roles: DataFrame, code: str) -> DataFrame:
    """(user_id, admin): whether the administrators' role is among the effective ones, asked live."""
    return effective_roles(users, user_roles, roles).select("user_id", F.array_contains("codes", code).alias("admin"))


def grants_of(grants: DataFrame, principal_type: str, principal_id: int) -> DataFrame:
    """(resource_id) granted to one principal, each once, sorted."""
    return grants.where((F.col("principal_type") == principal_type) & (F.col("principal_id") == principal_id)).select("resource_id").distinct().orderBy("resource_id")


def roles_to_pick(roles: DataFrame, hidden: str) -> DataFrame:
    """The roles that may be granted by hand, by id."""
    return roles.where(F.col("code") != hidden).orderBy("id")


def names(users: DataFrame, departments: DataFrame, roles: DataFrame) -> DataFrame:
    """(principal_type, principal_id, principal_name) of all principals."""
    parts = [users.select(F.lit("user").alias("principal_type"), F.col("id").alias("principal_id"), F.col("name").alias("principal_name")), departments.select(F.lit("dept").alias("principal_type"), F.col("id").alias("principal_id"), F.col("name").alias("principal_name")), roles.select(F.lit("role").alias("principal_type"), F.col("id").alias("principal_id"), F.col("code").alias("principal_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def grants_with_names(grants: DataFrame, known: DataFrame) -> DataFrame:
    """grants with principal_name; null where the principal is gone."""
    return grants.join(known, ["principal_type", "principal_id"], "left").select("resource_id", "principal_type", "principal_id", "principal_name")


def orphaned(grants: DataFrame, known: DataFrame) -> DataFrame:
    """grants to principals that don't exist."""
    return grants.join(known, ["principal_type", "principal_id"], "left_anti")


def replaced(grants: DataFrame, of: Column, wanted: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """grants in which those that `of` selects give way to `wanted`, each once, with outcome on every row.

    Where resources are given, ids that aren't among them abort the change: the grants stay as they are,
    and outcome is "unknown: " with how many there are and the smallest; else it is "replaced".
    """
    keys = grants.columns
    fresh = wanted.select(*keys).distinct()
    if resources is None:
        return grants.where(~of).unionByName(fresh).withColumn("outcome", F.lit("replaced"))
    unknown = fresh.join(resources.select(F.col("id").alias("resource_id")), "resource_id", "left_anti").select("resource_id").distinct()
    # One row, whatever is asked for.
    verdict = unknown.agg(F.count("*").alias("n"), F.min("resource_id").alias("least")).select(F.when(F.col("n") > 0, F.concat(F.lit("unknown: "), F.col("n").cast("string"), F.lit(" from "), F.col("least").cast("string"))).otherwise("replaced").alias("outcome"))
    rows = grants.select(F.struct(*keys).alias("row"), F.lit(False).alias("new"), of.alias("old")).unionByName(fresh.select(F.struct(*keys).alias("row"), F.lit(True).alias("new"), F.lit(False).alias("old")))
    kept = F.when(F.col("outcome") != "replaced", ~F.col("new")).otherwise(~F.col("old"))
    return rows.join(F.broadcast(verdict), how="cross").where(kept).select("row.*", "outcome")


def unknown_ids(wanted: DataFrame, resources: DataFrame) -> DataFrame:
    """(resource_id): those of wanted that don't exist, each once, sorted: the list that a refused replace tells."""
    return wanted.select("resource_id").distinct().join(resources.select(F.col("id").alias("resource_id")), "resource_id", "left_anti").orderBy("resource_id")


def grants_asked(asked: DataFrame, principal_type: str, known: DataFrame, grants: DataFrame) -> DataFrame:
    """(id, outcome, resources) of asked (id): not_found where there is no such principal (known: id), else ok with the ids granted to it, sorted, an empty list where there are none."""
    own = grants.where(F.col("principal_type") == principal_type).groupBy(F.col("principal_id").alias("id")).agg(F.array_sort(F.collect_set("resource_id")).alias("held"))
    found = asked.select("id").distinct().join(known.select("id", F.lit(True).alias("known")), "id", "left").join(own, "id", "left")
    none = F.expr("cast(array() as array<bigint>)")
    return found.select("id", F.when(F.col("known"), "ok").otherwise("not_found").alias("outcome"), F.when(F.col("known"), F.coalesce("held", none)).alias("resources"))


def upserted(grants: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grants with the missing rows of wanted, the rows added); an existing row stays one."""
    keys = ["resource_id", "principal_type", "principal_id"]
    added = wanted.select(*keys).distinct().join(grants, keys, "left_anti")
    return grants.select(*keys).unionByName(added), added


def removed(grants: DataFrame, unwanted: DataFrame) -> DataFrame:
    """grants without the rows of unwanted."""
    return grants.join(unwanted, ["resource_id", "principal_type", "principal_id"], "left_anti")


def roles_replaced(user_roles: DataFrame, user_id: int, codes: list[str], roles: DataFrame) -> DataFrame:
    """user_roles in which the user has the roles of codes and no others, each once, with outcome on every row; codes that don't exist abort the change, and outcome lists them, sorted."""
    asked = sorted(set(codes))
    # As many rows as are asked for.
    wanted = roles.sparkSession.createDataFrame([(c,) for c in asked], "code string").join(roles, "code", "left")
    verdict = wanted.agg(F.array_sort(F.collect_list(F.when(F.col("id").isNull(), F.col("code")))).alias("gone"))
    verdict = verdict.select(F.when(F.size("gone") > 0, F.concat(F.lit("unknown: "), F.array_join("gone", ","))).otherwise("replaced").alias("outcome"))
    new = wanted.where("id is not null").select(F.lit(user_id).cast("long").alias("user_id"), F.col("id").alias("role_id"))
    rows = user_roles.select("user_id", "role_id", F.lit(False).alias("new")).unionByName(new.withColumn("new", F.lit(True)))
    kept = F.when(F.col("outcome") == "replaced", F.col("new") | (F.col("user_id") != user_id)).otherwise(~F.col("new"))
    return rows.join(F.broadcast(verdict), how="cross").where(kept).select("user_id", "role_id", "outcome")


def snapshot_replaced(users: DataFrame, user_id: int, codes: list[str], roles: DataFrame) -> DataFrame:
    """users (id, roles_json, …) in which the user's snapshot is codes as they are given, in step with roles_replaced: codes that don't exist leave it as it was."""
    asked = roles.sparkSession.createDataFrame([(c,) for c in sorted(set(codes))], "code string")
    # One row, whatever is asked for.
    fine = asked.join(roles, "code", "left_anti").agg((F.count("*") == 0).alias("fine"))
    told = F.to_json(F.array(*[F.lit(c) for c in codes])) if codes else F.lit("[]")
    rows = users.select(F.struct(*users.columns).alias("row")).join(F.broadcast(fine), how="cross")
    hit = F.col("fine") & (F.col("row.id") == user_id)
    return rows.select(*[F.when(hit, told).otherwise(F.col("row.roles_json")).alias(c) if c == "roles_json" else F.col(f"row.{c}").alias(c) for c in users.columns])
