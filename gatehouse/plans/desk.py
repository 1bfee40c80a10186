"""Queries over single rows, changes, histories, uploads, forms and stream texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatehouse.functions import scalars
from gatehouse.operators import access, changes, corpus, directory, history, limits, ordering, tokens, turns, workflows
from gatehouse.plans.register import query
from gatehouse.sources import tables as T
from gatehouse.sources.tables import sql

CLOCK = "timestamp_ntz'2024-02-15 00:00:00'"


# Single rows and guards


@query(sql("SELECT id, name, email FROM users WHERE id = 42"))
def user_by_id(spark, sf):
    return T.users(spark, sf).where("id = 42").limit(1).select("id", "name", "email")


@query(sql("SELECT a.id, u.id AS found, r.id AS role_id FROM audit a LEFT JOIN users u ON u.email = 'customer.' || lpad((a.user_id * 2)::VARCHAR, 9, '0') || '@company.com' LEFT JOIN roles r ON r.code = ['BUILDING', 'building', 'MACHINERY'][a.id % 3 + 1]"))
def unique_key_lookups(spark, sf):
    """Users by email and roles by code, as joins on unique keys."""
    asked = T.audit(spark, sf).select("id", F.concat(F.lit("customer."), F.lpad((F.col("user_id") * 2).cast("string"), 9, "0"), F.lit("@company.com")).alias("email"), F.element_at(F.array(F.lit("BUILDING"), F.lit("building"), F.lit("MACHINERY")), (F.col("id") % 3 + 1).cast("int")).alias("code"))
    users = T.users(spark, sf).select(F.col("id").alias("found"), "email")
    roles = T.roles(spark, sf).select(F.col("id").alias("role_id"), "code")
    return asked.join(users, "email", "left").join(roles, "code", "left").select("id", "found", "role_id")


@query(sql("SELECT id, (id % 120) IN (SELECT id FROM resources) AS known FROM audit"))
def existence_probe(spark, sf):
    known = T.resources(spark, sf).select(F.col("id").alias("asked"), F.lit(True).alias("_k"))
    return T.audit(spark, sf).select("id", (F.col("id") % 120).alias("asked")).join(known, "asked", "left").select("id", F.coalesce("_k", F.lit(False)).alias("known"))


@query(sql("SELECT id, name FROM resources WHERE id IN (SELECT resource_id FROM grants WHERE principal_type = 'nobody')"))
def resources_of_nobody(spark, sf):
    """An empty list of ids lets no row through."""
    ids = access.grants_of(T.grants(spark, sf), "nobody", 0)
    return T.resources(spark, sf).join(ids.withColumnRenamed("resource_id", "id"), "id", "left_semi").select("id", "name")


@query(sql("SELECT a.id, CASE WHEN t.id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome FROM audit a LEFT JOIN talks t ON t.id = a.id % 160 AND t.user_id = a.user_id % 20 AND t.app_id = a.id % 10 AND NOT t.deleted"))
def conversation_guard(spark, sf):
    asked = T.audit(spark, sf).select("id", (F.col("id") % 160).alias("conversation_id"), (F.col("user_id") % 20).alias("user_id"), (F.col("id") % 10).alias("app_id"))
    return history.guarded(asked, T.conversations(spark, sf)).select("id", "outcome")


@query(sql("SELECT id, code FROM roles WHERE code <> 'PLATFORM_ADMIN' ORDER BY id"))
def roles_to_pick(spark, sf):
    return access.roles_to_pick(T.roles(spark, sf), "PLATFORM_ADMIN")


@query(sql("SELECT DISTINCT resource_id FROM grants WHERE principal_type = 'dept' AND principal_id = 107 ORDER BY resource_id"))
def grants_of_department(spark, sf):
    return access.grants_of(T.grants(spark, sf), "dept", 107)


@query(sql("SELECT u.id AS user_id, coalesce(bool_or(r.code = 'MACHINERY'), false) AS admin FROM users u LEFT JOIN user_roles x ON x.user_id = u.id LEFT JOIN roles r ON r.id = x.role_id GROUP BY u.id"))
def administrators_by_role(spark, sf):
    return access.administrators(T.users(spark, sf), T.user_roles(spark, sf), T.roles(spark, sf), "MACHINERY")


_ROLES_JSON = "CASE id % 4 WHEN 0 THEN '[\"BUILDING\",\"GONE\",\"BUILDING\"]' WHEN 1 THEN '[]' WHEN 2 THEN NULL ELSE '[\"GONE\"]' END"


def _told_json():
    return F.when(F.col("id") % 4 == 0, '["BUILDING","GONE","BUILDING"]').when(F.col("id") % 4 == 1, "[]").when(F.col("id") % 4 == 3, '["GONE"]')


def _told(spark, sf):
    return T.users(spark, sf).withColumn("roles_json", _told_json())


@query(sql("""SELECT u.id AS user_id, coalesce(h.codes, CASE u.id % 4 WHEN 0 THEN 'BUILDING,GONE,BUILDING' WHEN 3 THEN 'GONE' ELSE 'USER' END) AS codes FROM (SELECT id FROM users UNION ALL SELECT id + 10000000 FROM resources) u LEFT JOIN (
  SELECT x.user_id, string_agg(r.code, ',' ORDER BY r.id) AS codes FROM (SELECT DISTINCT * FROM user_roles) x JOIN roles r ON r.id = x.role_id GROUP BY x.user_id) h ON h.user_id = u.id"""))
def effective_roles_fallbacks(spark, sf):
    """Role rows, else the JSON snapshot, else the default role: users, and suppliers as accounts that have no role rows."""
    accounts = T.users(spark, sf).select("id").unionByName(T.resources(spark, sf).select((F.col("id") + 10_000_000).alias("id")))
    found = access.effective_roles(accounts.withColumn("roles_json", _told_json()), T.user_roles(spark, sf), T.roles(spark, sf))
    return found.select("user_id", F.array_join("codes", ",").alias("codes"))


@query(sql("SELECT id, CASE WHEN id = 6 THEN '[\"MACHINERY\",\"AUTOMOBILE\",\"MACHINERY\"]' ELSE CASE id % 4 WHEN 0 THEN '[\"BUILDING\",\"GONE\",\"BUILDING\"]' WHEN 1 THEN '[]' WHEN 3 THEN '[\"GONE\"]' END END AS roles_json FROM users"))
def user_roles_snapshot(spark, sf):
    """The JSON snapshot follows a replace of roles, as the codes were given."""
    return access.snapshot_replaced(_told(spark, sf).select("id", "roles_json"), 6, ["MACHINERY", "AUTOMOBILE", "MACHINERY"], T.roles(spark, sf))


@query(sql("SELECT a.id, CASE WHEN u.id IS NULL THEN 'unknown' WHEN u.status <> 1 THEN 'inactive' ELSE 'ok' END AS outcome FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'C' ELSE 'c' END || 'ustomer.' || lpad(user_id::VARCHAR, 9, '0') || '@company.com' AS e FROM audit) a LEFT JOIN users u ON u.email = a.e"))
def login_eligibility(spark, sf):
    """The email must be the same in every letter, and the user active."""
    email = F.concat(F.when(F.col("id") % 3 == 0, "C").otherwise("c"), F.lit("ustomer."), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@company.com"))
    return tokens.eligible(T.audit(spark, sf).select("id", email.alias("email")), T.users(spark, sf)).select("id", "outcome")


@query(sql("""SELECT a.id, CASE WHEN t.id IS NULL THEN 'missing' WHEN t.id % 4 = 0 THEN 'revoked' WHEN coalesce(u.status, 0) <> 1 THEN 'inactive_user' ELSE 'valid' END AS state FROM audit a
  LEFT JOIN audit t ON t.id = a.id AND a.action <> 'view' LEFT JOIN users u ON u.id = t.user_id"""))
def token_exchange_states(spark, sf):
    """Tokens by their hash; a hash without a token is missing."""
    held = T.audit(spark, sf).select("id", "user_id", F.sha2(F.col("id").cast("string"), 256).alias("token_hash"), F.when(F.col("id") % 4 == 0, F.col("created_at")).alias("revoked_at"), (F.col("created_at") + F.expr("interval 90 days")).alias("expires_at"))
    named = F.when(F.col("action") == "view", F.concat(F.lit("none "), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    asked = T.audit(spark, sf).select(F.col("id").alias("request"), F.sha2(named, 256).alias("token_hash"))
    return tokens.asked(asked, held, T.users(spark, sf), F.expr(CLOCK)).select(F.col("request").alias("id"), "state")


@query(sql("SELECT id, user_id, CASE WHEN id % 5 = 0 AND user_id % 2 = 0 THEN TIMESTAMP '2024-02-15' END AS revoked_at FROM audit UNION ALL SELECT id + 10000000, user_id, NULL FROM audit WHERE id % 5 = 0 AND user_id % 2 = 0"))
def token_rotation(spark, sf):
    """An exchanged token is revoked and a new one takes its place."""
    held = T.audit(spark, sf).select("id", "user_id", F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    used = held.where("id % 5 = 0 and user_id % 2 = 0").select("id", (F.col("id") + 10_000_000).alias("new_id"))
    return tokens.rotated(held, used, F.expr(CLOCK))


# Changes


@query(sql("""SELECT id, name, CASE id % 4 WHEN 0 THEN NULL WHEN 2 THEN 101 ELSE dept_id END AS dept_id, CASE WHEN id % 4 = 2 THEN 0 ELSE status END AS status FROM users"""))
def users_patched(spark, sf):
    """Fields that are set to null, that are set, and that aren't named."""
    users = T.users(spark, sf).select("id", "name", "dept_id", "status")
    fields = F.when(F.col("id") % 4 == 0, F.array(F.lit("dept_id"))).when(F.col("id") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("dept_id"), F.lit("status")))
    patches = users.where("id % 4 < 3").select("id", fields.alias("fields"), F.when(F.col("id") % 4 > 0, 101).cast("long").alias("dept_id"), F.when(F.col("id") % 4 > 0, 0).alias("status"))
    return changes.patched(users, patches)


@query(sql("SELECT id, user_id, action, detail FROM audit UNION ALL SELECT id + 10000000, user_id, 'export', CASE WHEN id % 2 = 0 THEN '{\"user_id\":' || user_id || ',\"action\":\"' || action || '\"}' END FROM audit WHERE id % 10 = 0"))
def audit_appended(spark, sf):
    """Rows with a detail as JSON and without one."""
    old = T.audit(spark, sf).select("id", "user_id", "action", "detail")
    new = old.where("id % 10 = 0").select((F.col("id") + 10_000_000).alias("id"), "user_id", F.lit("export").alias("action"), F.when(F.col("id") % 2 == 0, F.to_json(F.struct("user_id", "action"))).alias("detail"))
    return changes.appended(old, new)


def _to_role(spark, sf, of):
    return T.resources(spark, sf).select(F.col("id").alias("resource_id"), F.lit("role").alias("principal_type"), F.lit(of).cast("long").alias("principal_id"))


@query(sql("""SELECT resource_id, 'grant' AS action, '{"principal_type":"role","principal_id":1}' AS detail FROM (SELECT id AS resource_id, 'role' AS principal_type, 1::BIGINT AS principal_id FROM resources EXCEPT SELECT * FROM grants)"""))
def grants_upserted_audit(spark, sf):
    """Only grants that are new leave an audit row."""
    return changes.audit_rows(access.upserted(T.grants(spark, sf), _to_role(spark, sf, 1))[1], "grant", ["principal_type", "principal_id"])


@query(sql("""SELECT id AS resource_id, 'revoke' AS action, '{"principal_type":"role","principal_id":2}' AS detail FROM resources"""))
def grants_removed_audit(spark, sf):
    """Every removal leaves an audit row, also where there was nothing to remove."""
    return changes.audit_rows(_to_role(spark, sf, 2), "revoke", ["principal_type", "principal_id"])


@query(sql("SELECT id, code FROM roles UNION ALL SELECT 7, 'USER' UNION ALL SELECT 8, 'AUDITOR'"))
def roles_seeded(spark, sf):
    """Defaults are added where they are missing; twice is the same as once."""
    defaults = spark.createDataFrame([(7, "USER"), (8, "AUDITOR"), (9, "BUILDING"), (10, "PLATFORM_ADMIN")], "id long, code string")
    return changes.seeded(changes.seeded(T.roles(spark, sf), defaults, "code"), defaults, "code")


@query(sql("SELECT id AS user_id, CASE id % 4 WHEN 0 THEN 'BUILDING' ELSE 'USER' END AS code FROM users"))
def roles_migrated(spark, sf):
    """JSON arrays of roles to rows; unknown codes go, whoever has none left is a plain user."""
    return changes.roles_from_json(_told(spark, sf), T.roles(spark, sf))


@query(sql("SELECT x.user_id, x.role_id, 'replaced' AS outcome FROM user_roles x WHERE x.user_id <> 6 UNION ALL SELECT 6, unnest([0, 3]), 'replaced'"))
def user_roles_replaced(spark, sf):
    return access.roles_replaced(T.user_roles(spark, sf), 6, ["MACHINERY", "AUTOMOBILE", "MACHINERY"], T.roles(spark, sf))


@query(sql("SELECT user_id, role_id, 'unknown: ROOT,ZZZ' AS outcome FROM user_roles"))
def user_roles_rejected(spark, sf):
    """Unknown codes are told, sorted, and nothing changes."""
    return access.roles_replaced(T.user_roles(spark, sf), 6, ["ZZZ", "MACHINERY", "ROOT"], T.roles(spark, sf))


@query(sql("SELECT id, action FROM audit WHERE id % 7 > 0 UNION ALL SELECT min(id) + 10000000, arg_min(action, id) FROM audit WHERE id % 7 = 0 GROUP BY user_id"))
def audit_backfilled(spark, sf):
    """Late rows come in once a dedupe key, and not at all if their key is known."""
    all_ = T.audit(spark, sf).select("id", "user_id", "action")
    held = all_.where("id % 7 > 0").withColumn("key", F.concat(F.lit("e"), F.col("id").cast("string")))
    late = all_.where("id % 7 = 0").select((F.col("id") + 10_000_000).alias("id"), "user_id", "action", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"))
    again = held.select((F.col("id") + 20_000_000).alias("id"), "user_id", "action", "key")
    return changes.backfilled(held, late.unionByName(again), "key", "id").select("id", "action")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 10 > 0 UNION ALL SELECT doc_id + 10000000, 'new' FROM documents WHERE doc_id % 10 = 1")
def corpus_changed(spark, sf):
    """Documents deleted from a corpus and others put in."""
    docs = T.table(spark, sf, "documents").select("doc_id", "source")
    new = docs.where("doc_id % 10 = 1").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("new").alias("source"))
    return corpus.changed(docs, docs.where("doc_id % 10 = 0").select("doc_id"), new)


@query(sql("SELECT 'dept' AS kind, id FROM departments WHERE id <> 107 OR 107 IN (SELECT dept_id FROM users) UNION ALL SELECT 'grant', resource_id FROM grants WHERE NOT (principal_type = 'dept' AND principal_id = 107) OR 107 IN (SELECT dept_id FROM users)"))
def dept_deleted(spark, sf):
    """A department goes with its grants, unless someone is in it."""
    left, grants = directory.deleted(T.departments(spark, sf), T.users(spark, sf), T.grants(spark, sf), 107)
    return left.select(F.lit("dept").alias("kind"), "id").unionByName(grants.select(F.lit("grant").alias("kind"), F.col("resource_id").alias("id")))


# Lists in order


@query(sql("SELECT id, path, row_number() OVER (ORDER BY path, id) AS place FROM departments"))
def dept_list(spark, sf):
    """Departments by path, text order: /10/ before /2/."""
    return ordering.placed(directory.with_paths(T.departments(spark, sf)).select("id", "path"), [F.col("path"), F.col("id")])


@query(sql("SELECT resource_id, principal_type, principal_id, row_number() OVER (PARTITION BY resource_id ORDER BY principal_type, principal_id) AS place FROM grants"))
def grants_in_order(spark, sf):
    return T.grants(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("resource_id").orderBy("principal_type", "principal_id")))


@query(sql("SELECT id, action FROM audit WHERE id > 499 ORDER BY id LIMIT 100"))
def audit_keyset_batch(spark, sf):
    return directory.after(T.audit(spark, sf).select("id", "action"), "id", 499, 100)


@query(sql("SELECT id, action, ((row_number() OVER (ORDER BY id) - 1) // 100)::BIGINT AS batch FROM audit"))
def audit_keyset_batches(spark, sf):
    """All batches of a hundred rows by id, as a reader that goes on behind the last row of each gets them."""
    return directory.batches(T.audit(spark, sf).select("id", "action"), "id", 100)


@query(sql("SELECT conversation_id, string_agg(role, ',' ORDER BY first) AS speakers FROM (SELECT conversation_id, role, min(seq) AS first FROM messages GROUP BY conversation_id, role) GROUP BY conversation_id"))
def speakers_in_order(spark, sf):
    """Who speaks in a conversation, each once, in order of their first words."""
    told = F.array_sort(F.collect_list(F.struct("seq", "role"))).getField("role")
    return T.messages(spark, sf).groupBy("conversation_id").agg(F.array_join(F.array_distinct(told), ",").alias("speakers"))


@query(sql("SELECT t.id, t.user_id, r.name AS app_name FROM talks t JOIN resources r ON r.id = t.app_id WHERE NOT t.deleted"))
def history_with_apps(spark, sf):
    apps = T.resources(spark, sf).select(F.col("id").alias("app_id"), F.col("name").alias("app_name"))
    return T.conversations(spark, sf).where("not deleted").join(apps, "app_id").select("id", "user_id", "app_name")


@query(sql("SELECT id, 'remote' AS title, 1 AS source FROM talks WHERE id % 3 > 0 UNION ALL SELECT id, 'local', 0 FROM talks WHERE id % 3 = 0"))
def conversations_merged(spark, sf):
    """Local rows that the server doesn't know come first, all others are the server's."""
    own = T.conversations(spark, sf)
    return history.merged(own.select("id", F.lit("local").alias("title")), own.where("id % 3 > 0").select("id", F.lit("remote").alias("title")))


@query(sql("SELECT id, CASE WHEN id = 5 THEN 'now' ELSE 'before' END AS title, CASE WHEN id = 5 THEN 0 ELSE 1 END AS front FROM talks"))
def conversation_to_front(spark, sf):
    own = T.conversations(spark, sf).select("id", F.lit("before").alias("title"))
    return history.to_front(own, own.where("id = 5").select("id", F.lit("now").alias("title")))


@query(sql("SELECT a.id, coalesce(r.name, a.d::VARCHAR, '—') AS dataset FROM (SELECT id, CASE WHEN id % 9 > 0 THEN id % 120 END AS d FROM audit) a LEFT JOIN resources r ON r.id = a.d"))
def audit_dataset_names(spark, sf):
    asked = T.audit(spark, sf).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 120).alias("dataset_id"))
    return history.with_names(asked, "dataset_id", T.resources(spark, sf), "dataset").select("id", "dataset")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT * FROM c ORDER BY source LIMIT 5 OFFSET 5), k AS (SELECT * FROM p WHERE right(source, 1) < '6') SELECT source, n, (SELECT count(*) FROM k) AS total FROM k""")
def corpus_page_then_filter(spark, sf):
    """A page of the catalog of which only visible entries stay; the total is theirs."""
    return corpus.page_then_filter(T.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", F.substring("source", -1, 1) < "6", number=2, size=5)


@query("""WITH k AS (SELECT source, count(*) AS n FROM documents WHERE right(source, 1) < '6' GROUP BY source) SELECT source, n, (SELECT count(*) FROM k) AS total FROM k ORDER BY source LIMIT 5 OFFSET 5""")
def corpus_filter_then_page(spark, sf):
    """The same the other way round: pages of visible entries, and the total of all of them."""
    return corpus.filter_then_page(T.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", F.substring("source", -1, 1) < "6", number=2, size=5)


@query(sql("""SELECT conversation_id, '[' || string_agg('{"seq":' || seq || ',"role":' || to_json(role) || ',"content":' || to_json(content) || '}', ',' ORDER BY seq) || ']' AS json FROM messages GROUP BY conversation_id"""))
def conversation_export_json(spark, sf):
    return history.exported(T.messages(spark, sf))


# Uploads and settings


@query("""WITH c AS (SELECT page_id % 40 AS upload_id, page_id AS seq, length(html) AS size, coalesce(sum(length(html)) OVER (PARTITION BY page_id % 40 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages)
  SELECT upload_id, count(*) AS n_read, sum(size)::BIGINT AS bytes, CASE WHEN sum(size) > 4000 THEN 'too_large' ELSE 'ok' END AS outcome FROM c WHERE before <= 4000 GROUP BY upload_id""")
def upload_admission(spark, sf):
    """Chunks are read until their running sum is above the limit."""
    chunks = T.table(spark, sf, "pages").select((F.col("page_id") % 40).alias("upload_id"), F.col("page_id").alias("seq"), F.length("html").cast("long").alias("size"))
    return limits.admitted(chunks, 4000)


@query(sql("SELECT id FROM audit WHERE created_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY"))
def ttl_expired(spark, sf):
    return limits.expired(T.audit(spark, sf), "created_at", F.expr(CLOCK)).select("id")


@query(sql("SELECT count(*) AS removed FROM audit WHERE created_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY"))
def ttl_removed(spark, sf):
    return limits.expired(T.audit(spark, sf), "created_at", F.expr(CLOCK)).agg(F.count("*").alias("removed"))


@query(sql("""SELECT 'APP_K' || user_id AS key, CASE WHEN user_id % 7 = 0 THEN 'held' ELSE max_by(id || CASE WHEN id % 2 = 0 THEN '=x' ELSE '' END, id) END AS value, CASE WHEN user_id % 7 = 0 THEN 'held' ELSE 'file' END AS source FROM audit WHERE id % 5 < 3 OR user_id % 7 = 0 GROUP BY user_id"""))
def settings_read(spark, sf):
    """Lines of key=value with comments, other prefixes, repeated keys and values that hold =."""
    n, key = F.col("id").cast("string"), F.concat(F.lit("APP_K"), F.col("user_id").cast("string"))
    line = F.when(F.col("id") % 5 == 3, F.concat(F.lit("# "), key, F.lit("=no"))).when(F.col("id") % 5 == 4, F.concat(F.lit("OTHER="), n)).otherwise(F.concat(F.lit(" "), key, F.lit(" = "), n, F.when(F.col("id") % 2 == 0, "=x").otherwise("")))
    audit = T.audit(spark, sf)
    held = audit.where("user_id % 7 = 0").select(key.alias("key"), F.lit("held").alias("value")).distinct()
    return changes.key_values(audit.select(F.col("id").alias("at"), line.alias("line")), "APP_", held)


_NAME = "regexp_extract(url, '[^/]*$')"
_MIME = "['application/pdf', 'TEXT/Plain; q=1', 'text/markdown', 'image/png', 'image/gif', NULL][page_id % 6 + 1]"


def _files(spark, sf):
    mimes = F.array(*[F.lit(x) for x in ("application/pdf", "TEXT/Plain; q=1", "text/markdown", "image/png", "image/gif", None)])
    ending = F.element_at(F.array(F.lit(""), F.lit(".TXT"), F.lit(".tar.gz"), F.lit(".x-y")), (F.col("page_id") % 4 + 1).cast("int"))
    return T.table(spark, sf, "pages").select("page_id", F.concat(F.substring_index("url", "/", -1), ending).alias("name"), F.element_at(mimes, (F.col("page_id") % 6 + 1).cast("int")).alias("mime"), (F.length("html") * 3000).cast("long").alias("size"))


_FILES = f"(SELECT page_id, {_NAME} || ['', '.TXT', '.tar.gz', '.x-y'][page_id % 4 + 1] AS name, {_MIME} AS mime, (length(html) * 3000)::BIGINT AS size FROM pages)"
_TYPES = "('application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/plain', 'text/markdown', 'image/png', 'image/jpeg')"


@query(f"SELECT page_id, CASE WHEN size > 20971520 THEN 'size' WHEN NOT (ends_with(lower(name), '.txt') OR ends_with(lower(name), '.md')) AND coalesce(mime NOT IN {_TYPES}, true) THEN 'type' END AS reason FROM {_FILES}")
def file_reasons(spark, sf):
    return _files(spark, sf).select("page_id", scalars.file_reason(F.col("name"), F.col("size"), F.col("mime")).alias("reason"))


@query(f"""SELECT page_id, coalesce(nullif(lower(regexp_extract(name, '\\.([A-Za-z0-9]{{1,8}})$', 1)), ''), 'bin') AS extension, lower(trim(split_part(mime, ';', 1))) AS type, CASE WHEN starts_with(lower(trim(split_part(mime, ';', 1))), 'image/') THEN 'image' ELSE 'document' END AS class,
  CASE mime WHEN 'application/pdf' THEN 'pdf' WHEN 'text/markdown' THEN 'markdown' WHEN 'image/png' THEN 'image' ELSE 'generic' END AS kind,
  CASE mime WHEN 'application/pdf' THEN '#DC2626' WHEN 'text/markdown' THEN '#0F766E' WHEN 'image/png' THEN '#D97706' ELSE '#94A3B8' END AS colour FROM {_FILES}""")
def file_kinds(spark, sf):
    mime = F.col("mime")
    return _files(spark, sf).select("page_id", scalars.safe_extension(F.col("name")).alias("extension"), scalars.mime_type(mime).alias("type"), scalars.mime_class(mime).alias("class"), scalars.mime_kind(mime).alias("kind"), scalars.mime_colour(mime).alias("colour"))


# Forms, labels and other scalars


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS own, c_custkey % 3 = 0 AS blank FROM customer")
def texts_stripped(spark, sf):
    pad = F.when(F.col("c_custkey") % 3 == 0, " \t　").otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit("　\n")))
    return T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), scalars.stripped(pad).alias("own"), scalars.is_blank(pad).alias("blank"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'topic' ELSE 'tone' END AS missing, left(CASE doc_id % 4 WHEN 0 THEN lang || source || 'abcdefghijklmnop' WHEN 2 THEN source ELSE 'q' || doc_id END, 20) AS title FROM documents""")
def form_checked(spark, sf):
    """The first required input that is missing, and the title from the first input there is, in the form's order."""
    kind = F.col("doc_id") % 4
    topic = F.when(kind == 0, F.concat(F.lit(" "), "lang", "source", F.lit("abcdefghijklmnop "))).when(kind == 1, F.lit(" 　")).when(kind == 2, F.col("source")).otherwise(F.lit("x"))
    inputs = F.map_filter(F.create_map(F.lit("tone"), F.when(kind == 0, F.lit("dry")), F.lit("topic"), topic), lambda k, v: v.isNotNull() & ~((kind == 3) & (k == "topic")))
    order = F.array(F.lit("topic"), F.lit("tone"))
    required = F.when(kind == 3, F.array(F.lit("tone"))).otherwise(order)
    docs = T.table(spark, sf, "documents")
    return docs.select("doc_id", scalars.first_missing(required, inputs).alias("missing"), scalars.workflow_title(order, inputs, F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("title"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang WHEN text IS NULL THEN '{}' ELSE left('{"text":' || to_json(text) || '}', 8000) END AS content FROM documents""")
def turn_contents(spark, sf):
    """The question, or the beginning of the inputs as JSON."""
    return T.table(spark, sf, "documents").select("doc_id", scalars.content_of(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.struct("text")).alias("content"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS uuid FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events)")
def uuids_read(spark, sf):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    told = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.upper(h), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 24))).otherwise(F.substring(h, 1, 31))
    return T.table(spark, sf, "events").select("event_id", scalars.uuid_of(told).alias("uuid"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS time FROM events")
def iso_times(spark, sf):
    return T.table(spark, sf, "events").select("event_id", scalars.iso_utc(F.when(F.col("event_id") % 5 > 0, F.col("ts"))).alias("time"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN '已完成' WHEN 'click' THEN '索引中' WHEN 'error' THEN '失败（no memory left on this n）' ELSE event_type END AS label, event_type IN ('view', 'error') AS finished FROM events")
def status_labels(spark, sf):
    status = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "indexing").otherwise(F.col("event_type"))
    error = F.when(F.col("event_type") == "error", "no memory left on this node").when(F.col("event_type") == "view", "")
    return T.table(spark, sf, "events").select("event_id", scalars.status_label(status, error).alias("label"), scalars.is_finished(status).alias("finished"))


@query("SELECT event_id, event_id % 5 = 4 AS stale FROM events")
def versions_stale(spark, sf):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("event_id") % 5 + 1).cast("int"))
    return T.table(spark, sf, "events").select("event_id", scalars.stale(pick("1.0", "dev", "1.0", None, "1.1"), pick("1.0", "1.0", "", "1.0", "1.0")).alias("stale"))


@query("SELECT event_id, ['ok', '404 gone', '409 in_use', '403 HTTP 403', '502 HTTP 503', '502 no JSON', '502 unreachable', 'ok'][event_id % 8 + 1] AS outcome FROM events")
def upstream_outcomes(spark, sf):
    pick = lambda *x: F.element_at(F.array(*x), (F.col("event_id") % 8 + 1).cast("int"))
    status = pick(*[F.lit(x).cast("int") for x in (200, 404, 409, 403, 503, 200, None, 204)])
    body = pick(*[F.lit(x) for x in ('{"id":1}', '{"code":"c","message":"gone"}', '{"code":"in_use"}', "<html>", "", "<html>", None, "")])
    return T.table(spark, sf, "events").select("event_id", scalars.upstream_outcome(status, body).alias("outcome"))


@query("SELECT event_id, concat_ws('&', 'kind=' || event_type, CASE WHEN event_id % 2 = 0 THEN 'n=' || event_id END) AS query FROM events")
def params_given(spark, sf):
    """Parameters that are null or empty are left out."""
    params = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("n"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")), F.lit("q"), F.lit(""))
    entries = F.transform(F.map_entries(scalars.given(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return T.table(spark, sf, "events").select("event_id", F.array_join(entries, "&").alias("query"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END, ''), 'field' || l_linenumber) AS label, CASE WHEN l_linenumber % 3 = 0 THEN '请输入' || coalesce(nullif(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END, ''), 'field' || l_linenumber) END AS rule FROM lineitem")
def form_labels(spark, sf):
    """A field's label, its name where it has none, and the message of a required one."""
    fields = T.table(spark, sf, "lineitem")
    label = F.coalesce(F.nullif(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(""), F.lit("")), F.concat(F.lit("field"), F.col("l_linenumber").cast("string")))
    return fields.select("l_orderkey", "l_linenumber", label.alias("label"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("请输入"), label)).alias("rule"))


# Stream texts


@query(sql("SELECT stream_id, seq, 'event: ' || coalesce(event, 'message') || chr(10) || 'data: ' || data || chr(10) || chr(10) AS text FROM frames"))
def sse_texts(spark, sf):
    return T.frames(spark, sf).select("stream_id", "seq", turns.sse(F.coalesce("event", F.lit("message")), F.col("data")).alias("text"))


@query(sql("SELECT stream_id, (row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1)::BIGINT AS n, coalesce(event, '') AS event, data FROM frames"))
def chunks_to_frames(spark, sf):
    """The text of each stream, cut anywhere into chunks of seven characters, and its frames read from them."""
    text = F.concat(F.when(F.col("event").isNotNull(), F.concat(F.lit("event: "), F.col("event"), F.lit("\r\n"))).otherwise(""), F.lit("data: "), F.col("data"), F.lit("\n\n"))
    whole = T.frames(spark, sf).groupBy("stream_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", text.alias("x")))).getField("x"), "").alias("t"))
    chunks = whole.select("stream_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 7).cast("int"))).alias("seq")).select("stream_id", F.col("seq").cast("long").alias("seq"), F.expr("substring(t, seq * 7 + 1, 7)").alias("chunk"))
    frames = turns.split_frames(turns.lines_of_chunks(chunks))
    numbered = frames.withColumn("n", F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")).cast("long") - 1)
    return numbered.select("stream_id", "n", F.coalesce("event", F.lit("")).alias("event"), "data")


@query(sql("SELECT stream_id, seq, coalesce(event, 'message') AS event, CASE WHEN json_valid(data) THEN data ELSE '{}' END AS data FROM frames WHERE seq % 7 > 0"))
def frames_dispatched(spark, sf):
    """Unknown events are ignored, broken data is an empty object."""
    return turns.dispatched(T.frames(spark, sf).withColumn("event", F.when(F.col("seq") % 7 == 0, "odd").otherwise(F.col("event"))))


_REASONS = ("normal", "timeout", "http_503", "proxy_error", "client_abort", "connection_lost")


def _closes(spark, sf):
    reasons = F.array(*[F.lit(x) for x in _REASONS])
    return T.frames(spark, sf).select("stream_id").distinct().select("stream_id", F.element_at(reasons, (F.col("stream_id") % 6 + 1).cast("int")).alias("reason"))


@query(sql("""SELECT stream_id, 0 AS sub_seq, 'error' AS event, '{"message":"' || CASE stream_id % 6 WHEN 1 THEN 'Upstream timeout' WHEN 2 THEN 'Upstream error: 503' ELSE 'Proxy error' END || '"}' AS data FROM (SELECT DISTINCT stream_id FROM frames) WHERE stream_id % 6 IN (1, 2, 3)
  UNION ALL SELECT stream_id, 1, 'agent_done', '{"conversation_id":"' || stream_id || '"}' FROM (SELECT DISTINCT stream_id FROM frames) WHERE stream_id % 6 <> 4"""))
def streams_closed(spark, sf):
    return turns.closed(_closes(spark, sf))


@query(sql("""SELECT stream_id, CASE WHEN stream_id % 6 IN (1, 2, 3, 5) OR (stream_id % 6 = 0 AND error_at IS NOT NULL) THEN 'error' ELSE 'done' END AS status,
  CASE stream_id % 6 WHEN 1 THEN 'Upstream timeout' WHEN 2 THEN 'Upstream error: 503' WHEN 3 THEN 'Proxy error' WHEN 5 THEN '连接中断，请重试' ELSE coalesce(wrong, '') || coalesce(text, '') END AS content FROM (
  SELECT f.stream_id, any_value(e.error_at) AS error_at, any_value(e.wrong) AS wrong, string_agg(CASE WHEN name = 'message' AND (e.error_at IS NULL OR f.seq > e.error_at) THEN nullif(answer, 'null') END, '' ORDER BY f.seq) AS text
  FROM (SELECT stream_id, seq, CASE WHEN json_valid(data) THEN coalesce(event, data->>'$.event') ELSE coalesce(event, 'message') END AS name, CASE WHEN json_valid(data) THEN data->>'$.answer' END AS answer FROM frames) f
  LEFT JOIN (SELECT stream_id, max(seq) AS error_at, arg_max(coalesce(CASE WHEN json_valid(data) THEN data->>'$.message' END, '回答生成失败，请重试'), seq) AS wrong FROM frames WHERE event = 'error' GROUP BY stream_id) e ON e.stream_id = f.stream_id GROUP BY f.stream_id)"""))
def turn_states(spark, sf):
    """How each turn stands on its reader's page at the end: an error's message takes the answer's place and isn't overwritten, an abort keeps what stands there."""
    return turns.states(turns.translate_chat(T.frames(spark, sf)), _closes(spark, sf))


@query(sql("SELECT stream_id, (seq * 23 // 80)::BIGINT AS flush, string_agg('d' || seq, '' ORDER BY seq) AS text FROM frames GROUP BY ALL"))
def deltas_flushed(spark, sf):
    deltas = T.frames(spark, sf).select("stream_id", "seq", (F.col("seq") * 23).alias("at"), F.concat(F.lit("d"), F.col("seq").cast("string")).alias("delta"))
    return history.flushed(deltas, "at", "delta")


# Workflow graphs


NODES = """g AS (SELECT l_orderkey AS graph_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS node_id, count(*) OVER (PARTITION BY l_orderkey) AS last FROM lineitem),
  nodes AS (SELECT graph_id, node_id, last, CASE WHEN node_id = 1 THEN CASE WHEN graph_id % 11 = 0 THEN 'llm' ELSE 'start' END WHEN node_id = last AND graph_id % 7 > 0 THEN 'answer' WHEN node_id = 2 AND graph_id % 3 = 0 THEN 'if-else' ELSE 'llm' END AS kind FROM g),
  edges AS (SELECT graph_id, node_id AS source, node_id + 1 AS target, CASE WHEN kind = 'if-else' THEN 'true' END AS handle FROM nodes WHERE node_id < last AND NOT (graph_id % 5 = 0 AND node_id = 2)
    UNION ALL SELECT graph_id, node_id, last, 'false' FROM nodes WHERE kind = 'if-else' AND graph_id % 13 > 0 UNION ALL SELECT graph_id, node_id, 2, NULL FROM nodes WHERE node_id = 3 AND graph_id % 4 = 0)"""


@query(f"""WITH RECURSIVE {NODES},
  fwd AS (SELECT graph_id, node_id FROM nodes WHERE kind = 'start' UNION SELECT e.graph_id, e.target FROM fwd f JOIN edges e ON e.graph_id = f.graph_id AND e.source = f.node_id),
  bwd AS (SELECT graph_id, node_id FROM nodes WHERE kind = 'answer' UNION SELECT e.graph_id, e.source FROM bwd f JOIN edges e ON e.graph_id = f.graph_id AND e.target = f.node_id),
  o AS (SELECT e.graph_id, e.source AS node_id, count(*) AS n, count(*) FILTER (WHERE b.node_id IS NULL) AS dead, count(*) FILTER (WHERE handle IS NOT NULL) AS branches, count(*) FILTER (WHERE handle IS NOT NULL AND b.node_id IS NULL) AS dead_branches
    FROM edges e LEFT JOIN bwd b ON b.graph_id = e.graph_id AND b.node_id = e.target GROUP BY e.graph_id, e.source)
  SELECT graph_id, CASE WHEN count(*) FILTER (WHERE kind = 'start') <> 1 THEN 'starts' WHEN count(*) FILTER (WHERE kind = 'answer') = 0 THEN 'no_answer' WHEN count(*) FILTER (WHERE kind = 'start' AND n IS NULL) > 0 THEN 'start_open' WHEN count(*) FILTER (WHERE kind = 'start' AND dead > 0) > 0 THEN 'dead_end'
    WHEN count(*) FILTER (WHERE kind = 'if-else' AND coalesce(branches, 0) <> 2) > 0 THEN 'branches' WHEN count(*) FILTER (WHERE kind = 'if-else' AND dead_branches > 0) > 0 THEN 'dead_branch' WHEN count(*) FILTER (WHERE found IS NULL) > 0 THEN 'orphans' ELSE 'ok' END AS outcome
  FROM (SELECT n.graph_id, n.kind, o.n, o.dead, o.branches, o.dead_branches, f.node_id AS found FROM nodes n LEFT JOIN o ON o.graph_id = n.graph_id AND o.node_id = n.node_id LEFT JOIN fwd f ON f.graph_id = n.graph_id AND f.node_id = n.node_id) GROUP BY graph_id""")
def workflows_validated(spark, sf):
    return workflows.validated(*workflow_graphs(spark, sf))


def workflow_graphs(spark, sf):
    """(nodes, edges): a graph an order, its nodes in a row, with branches, loops, gaps, and graphs without a start or an answer."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    item = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("graph_id"), place.cast("long").alias("node_id"))
    nodes = item.withColumn("last", F.max("node_id").over(Window.partitionBy("graph_id")))
    own = F.when(F.col("node_id") == 1, F.when(F.col("graph_id") % 11 == 0, "llm").otherwise("start")).when((F.col("node_id") == F.col("last")) & (F.col("graph_id") % 7 > 0), "answer").when((F.col("node_id") == 2) & (F.col("graph_id") % 3 == 0), "if-else").otherwise("llm")
    nodes = nodes.withColumn("kind", own)
    edge = lambda held, target, handle: F.when(held, F.struct(F.col("node_id").alias("source"), target.cast("long").alias("target"), F.lit(handle).cast("string").alias("handle") if handle is None else handle.alias("handle")))
    chain = edge((F.col("node_id") < F.col("last")) & ~((F.col("graph_id") % 5 == 0) & (F.col("node_id") == 2)), F.col("node_id") + 1, F.when(F.col("kind") == "if-else", "true"))
    other = edge((F.col("kind") == "if-else") & (F.col("graph_id") % 13 > 0), F.col("last"), F.lit("false"))
    loop = edge((F.col("node_id") == 3) & (F.col("graph_id") % 4 == 0), F.lit(2), None)
    # Written out of their nodes, so that they are where these are.
    return nodes, nodes.select("graph_id", F.inline(F.array_compact(F.array(chain, other, loop))))
