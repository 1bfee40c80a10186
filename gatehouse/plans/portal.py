"""Queries over access, directory, conversations, audit, corpus and tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatehouse.functions import scalars
from gatehouse.operators import access, corpus, directory, history, limits, tokens
from gatehouse.plans.register import query
from gatehouse.sources import files
from gatehouse.sources import tables as T
from gatehouse.sources.scratch import shared_dir
from gatehouse.sources.tables import sql

CLOCK = "2024-01-31 00:00:00"


def _access(spark, sf):
    return T.users(spark, sf), T.user_roles(spark, sf), T.grants(spark, sf), T.resources(spark, sf), T.roles(spark, sf)


@query(sql("SELECT user_id, resource_id FROM visible"))
def access_visible_resources(spark, sf):
    return access.visible(*_access(spark, sf))


@query(sql(f"SELECT v.user_id, v.resource_id, false AS unrestricted FROM visible v WHERE v.user_id NOT IN (SELECT user_id FROM admins) UNION ALL SELECT a.user_id, NULL, true FROM admins a JOIN users u ON u.id = a.user_id WHERE u.status = 1"))
def access_scopes(spark, sf):
    """What each user sees by grants; administrators, told by their live roles, are one row without a list."""
    return access.scopes(*_access(spark, sf))


@query(sql("SELECT q.id, CASE WHEN u.id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome, CASE WHEN u.id IS NOT NULL THEN coalesce((SELECT string_agg(g.resource_id, ',' ORDER BY g.resource_id) FROM grants g WHERE g.principal_type = 'user' AND g.principal_id = q.id), '') END AS resources FROM (SELECT id * 2 AS id FROM users) q LEFT JOIN users u ON u.id = q.id"))
def grants_of_users_asked(spark, sf):
    """Grants of many users: one who doesn't exist is told apart from one without any."""
    asked = T.users(spark, sf).select((F.col("id") * 2).alias("id"))
    found = access.grants_asked(asked, "user", T.users(spark, sf), T.grants(spark, sf))
    return found.withColumn("resources", F.array_join("resources", ","))


@query(sql("SELECT DISTINCT id * 3 AS resource_id FROM users WHERE id * 3 NOT IN (SELECT id FROM resources) ORDER BY 1"))
def grants_unknown_ids(spark, sf):
    """The whole list of ids that a replace would be refused for."""
    return access.unknown_ids(T.users(spark, sf).select((F.col("id") * 3).alias("resource_id")), T.resources(spark, sf))


@query(sql("SELECT r.id, r.name, row_number() OVER (ORDER BY r.id) AS place FROM visible v JOIN resources r ON r.id = v.resource_id WHERE v.user_id = 7"))
def my_apps(spark, sf):
    """What one user sees, by id."""
    users, held, grants, resources, roles = _access(spark, sf)
    seen = access.visible(users.where("id = 7"), held, grants, resources, roles).select(F.col("resource_id").alias("id"))
    own = resources.join(seen, "id", "left_semi").select("id", "name")
    return own.withColumn("place", F.row_number().over(Window.orderBy("id")))  # one user's apps


@query(sql("SELECT v.user_id, count(*) AS n_resources FROM visible v JOIN admins a ON a.user_id = v.user_id GROUP BY v.user_id"))
def access_admin_bypass(spark, sf):
    users, held, *rest, roles = _access(spark, sf)
    admins = access.admin_ids(users, held, roles).withColumnRenamed("user_id", "id")
    return access.counted(users.join(admins, "id", "left_semi"), held, *rest, roles)


@query(sql("""SELECT a.id, a.user_id, (a.id % 120)::BIGINT AS resource_id, CASE WHEN r.id IS NULL THEN 'not_found' WHEN coalesce(u.status, 0) <> 1 OR r.status <> 1 THEN 'inactive'
  WHEN v.user_id IS NOT NULL THEN 'allow' ELSE 'deny' END AS outcome FROM audit a LEFT JOIN users u ON u.id = a.user_id LEFT JOIN resources r ON r.id = a.id % 120
  LEFT JOIN visible v ON v.user_id = a.user_id AND v.resource_id = a.id % 120"""))
def access_decision_log(spark, sf):
    asked = T.audit(spark, sf).select("id", "user_id", (F.col("id") % 120).alias("resource_id"))
    return access.decided(asked, *_access(spark, sf))


@query(sql("SELECT id AS user_id FROM users WHERE status = 1 AND id NOT IN (SELECT user_id FROM visible)"))
def access_default_closed(spark, sf):
    return access.closed(*_access(spark, sf))


@query(sql("SELECT x.user_id, string_agg(r.code, ',' ORDER BY r.id) AS codes FROM (SELECT DISTINCT * FROM user_roles) x JOIN roles r ON r.id = x.role_id GROUP BY x.user_id"))
def access_effective_roles(spark, sf):
    found = access.effective_roles(T.users(spark, sf), T.user_roles(spark, sf), T.roles(spark, sf))
    return found.select("user_id", F.array_join("codes", ",").alias("codes"))


@query(sql("SELECT r.id AS resource_id, count(v.user_id) AS n_users FROM resources r LEFT JOIN visible v ON v.resource_id = r.id GROUP BY r.id"))
def access_reach(spark, sf):
    return access.reach(*_access(spark, sf))


@query(sql("""SELECT g.resource_id, g.principal_type, g.principal_id, coalesce(u.name, d.name, r.code) AS principal_name FROM grants g
  LEFT JOIN users u ON g.principal_type = 'user' AND u.id = g.principal_id LEFT JOIN departments d ON g.principal_type = 'dept' AND d.id = g.principal_id
  LEFT JOIN roles r ON g.principal_type = 'role' AND r.id = g.principal_id"""))
def grants_with_names(spark, sf):
    return access.grants_with_names(T.grants(spark, sf), access.names(T.users(spark, sf), T.departments(spark, sf), T.roles(spark, sf)))


@query(sql("""SELECT g.resource_id, g.principal_type, g.principal_id FROM grants g LEFT JOIN users u ON g.principal_type = 'user' AND u.id = g.principal_id
  LEFT JOIN departments d ON g.principal_type = 'dept' AND d.id = g.principal_id LEFT JOIN roles r ON g.principal_type = 'role' AND r.id = g.principal_id WHERE u.id IS NULL AND d.id IS NULL AND r.id IS NULL"""))
def grants_orphaned(spark, sf):
    return access.orphaned(T.grants(spark, sf), access.names(T.users(spark, sf), T.departments(spark, sf), T.roles(spark, sf)))


_OLD = "SELECT resource_id, principal_type, principal_id, '%s' AS outcome FROM grants"
_OTHERS = f"{_OLD % 'replaced'} WHERE NOT (principal_type = 'dept' AND principal_id = 103)"


def _replaced(spark, sf, first: int, checked: bool):
    wanted = spark.range(first, first + 9).select(F.col("id").alias("resource_id"), F.lit("dept").alias("principal_type"), F.lit(103).cast("long").alias("principal_id"))
    of = (F.col("principal_type") == "dept") & (F.col("principal_id") == 103)
    return access.replaced(T.grants(spark, sf), of, wanted.unionByName(wanted), T.resources(spark, sf) if checked else None)


@query(sql(f"{_OTHERS} UNION ALL SELECT id, 'dept', 103, 'replaced' FROM resources WHERE id BETWEEN 1 AND 9"))
def grants_replaced(spark, sf):
    return _replaced(spark, sf, 1, True)


@query(sql(_OLD % "unknown: 8 from 1000000"))
def grants_replace_rejected(spark, sf):
    """Ids that don't exist abort the change."""
    wanted = spark.range(999_993, 1_000_008).select(F.greatest(F.col("id"), F.lit(1_000_000)).alias("resource_id"), F.lit("dept").alias("principal_type"), F.lit(103).cast("long").alias("principal_id"))
    return access.replaced(T.grants(spark, sf), (F.col("principal_type") == "dept") & (F.col("principal_id") == 103), wanted, T.resources(spark, sf))


@query(sql(f"{_OTHERS} UNION ALL SELECT unnest(range(999999, 1000008)), 'dept', 103, 'replaced'"))
def grants_replaced_unchecked(spark, sf):
    return _replaced(spark, sf, 999_999, False)


@query(sql("SELECT * FROM (SELECT id AS resource_id, 'role' AS principal_type, 1::BIGINT AS principal_id FROM resources) EXCEPT SELECT * FROM grants"))
def grants_upserted(spark, sf):
    wanted = T.resources(spark, sf).select(F.col("id").alias("resource_id"), F.lit("role").alias("principal_type"), F.lit(1).cast("long").alias("principal_id"))
    return access.upserted(T.grants(spark, sf), wanted)[1]


@query(sql("SELECT * FROM grants EXCEPT SELECT id, 'dept', 105 FROM resources"))
def grants_removed(spark, sf):
    unwanted = T.resources(spark, sf).select(F.col("id").alias("resource_id"), F.lit("dept").alias("principal_type"), F.lit(105).cast("long").alias("principal_id"))
    return access.removed(T.grants(spark, sf), unwanted)


@query(sql("SELECT id, name, email, dept_id, status FROM users WHERE (name ILIKE '%00001%' OR email ILIKE '%00001%') AND status = 1 ORDER BY id OFFSET 5 LIMIT 5"))
def directory_search_page(spark, sf):
    found = directory.filtered(T.users(spark, sf), query="00001", status=1)
    return directory.page(found.select("id", "name", "email", "dept_id", "status"), [F.col("id")], number=2, size=5)


@query(sql("SELECT count(*) AS total FROM users WHERE (name ILIKE '%0001%' OR email ILIKE '%0001%') AND dept_id = 105"))
def directory_total(spark, sf):
    return directory.filtered(T.users(spark, sf), query="0001", dept_id=105).agg(F.count("*").alias("total"))


@query(sql("""SELECT u.id, u.name, d.name AS dept_name, string_agg(r.code, ',' ORDER BY r.id) AS codes FROM users u LEFT JOIN departments d ON d.id = u.dept_id
  LEFT JOIN (SELECT DISTINCT * FROM user_roles) x ON x.user_id = u.id LEFT JOIN roles r ON r.id = x.role_id GROUP BY ALL"""))
def directory_with_roles(spark, sf):
    users = T.users(spark, sf)
    codes = access.effective_roles(users, T.user_roles(spark, sf), T.roles(spark, sf)).select(F.col("user_id").alias("id"), F.array_join("codes", ",").alias("codes"))
    depts = T.departments(spark, sf).select(F.col("id").alias("dept_id"), F.col("name").alias("dept_name"))
    return users.join(depts, "dept_id", "left").join(codes, "id").select("id", "name", "dept_name", "codes")


@query(sql("SELECT id, name, parent_id, path FROM departments"))
def dept_paths(spark, sf):
    return directory.with_paths(T.departments(spark, sf))


@query(sql("SELECT d.id, count(u.id) AS n_users FROM departments d JOIN departments b ON starts_with(b.path, d.path) LEFT JOIN users u ON u.dept_id = b.id GROUP BY d.id"))
def dept_subtree_counts(spark, sf):
    above = directory.ancestors(directory.with_paths(T.departments(spark, sf)))
    held = T.users(spark, sf).groupBy(F.col("dept_id").alias("id")).agg(F.count("*").alias("n"))
    return above.join(held, "id", "left").groupBy(F.col("ancestor_id").alias("id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_users"))


@query(sql("SELECT id, name, path FROM departments WHERE starts_with(path, '/2/')"))
def dept_subtree(spark, sf):
    return directory.subtree(directory.with_paths(T.departments(spark, sf)), "/2/").select("id", "name", "path")


@query(sql("SELECT id, name, CASE WHEN id = 2 THEN 1 ELSE parent_id END AS parent_id, CASE WHEN starts_with(path, '/2/') THEN '/1' || path ELSE path END AS path, 'moved' AS outcome FROM departments"))
def dept_move_subtree(spark, sf):
    return directory.moved(directory.with_paths(T.departments(spark, sf)), 2, 1)


@query(sql("SELECT id, name, parent_id, path, o.outcome FROM departments, (SELECT unnest(['not_found', 'unknown_parent', 'self_parent']) AS outcome) o"))
def dept_move_refused(spark, sf):
    """Moves of an unknown department, below an unknown one, and below itself change nothing."""
    paths = directory.with_paths(T.departments(spark, sf))
    return directory.moved(paths, 99_999, 1).unionByName(directory.moved(paths, 1, 99_999)).unionByName(directory.moved(paths, 1, 1))


@query(sql("SELECT id, name, parent_id, path, 'cycle' AS outcome FROM departments"))
def dept_move_cycle(spark, sf):
    return directory.moved(directory.with_paths(T.departments(spark, sf)), 1, 100)


@query(sql("SELECT id, CASE WHEN id IN (SELECT parent_id FROM departments WHERE parent_id IS NOT NULL) THEN 'has_children' WHEN id IN (SELECT dept_id FROM users WHERE dept_id IS NOT NULL) THEN 'has_users' ELSE 'ok' END AS outcome FROM departments"))
def dept_delete_guard(spark, sf):
    return directory.delete_guard(T.departments(spark, sf), T.users(spark, sf))


@query(sql("SELECT id, app_id, last_seq, 1 + (SELECT count(*) FROM talks o WHERE o.user_id = t.user_id AND NOT o.deleted AND (o.last_seq, o.id) > (t.last_seq, t.id)) AS place FROM talks t WHERE user_id = 3 AND NOT deleted ORDER BY place LIMIT 100"))
def conversation_list(spark, sf):
    """One user's own conversations, the latest first; 500 asked for are 100 at most."""
    return history.own(T.conversations(spark, sf), 3, limit=500)


@query(sql("SELECT id, app_id, last_seq, row_number() OVER (ORDER BY last_seq DESC, id DESC) AS place FROM talks WHERE user_id = 4 AND app_id = 4 AND NOT deleted ORDER BY place LIMIT 1"))
def conversation_list_of_app(spark, sf):
    return history.own(T.conversations(spark, sf), 4, app_id=4, limit=0)


@query(sql("SELECT id, user_id, app_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, app_id ORDER BY last_seq DESC, id DESC) AS r FROM talks WHERE NOT deleted) WHERE r = 1"))
def latest_conversation(spark, sf):
    latest = Window.partitionBy("user_id", "app_id").orderBy(F.desc("last_seq"), F.desc("id"))
    return T.conversations(spark, sf).where(~F.col("deleted")).withColumn("r", F.row_number().over(latest)).where("r = 1").select("id", "user_id", "app_id")


@query(sql("SELECT conversation_id, seq, role, content FROM messages WHERE conversation_id IN (SELECT id FROM talks WHERE NOT deleted)"))
def messages_ordered(spark, sf):
    live = T.conversations(spark, sf).where(~F.col("deleted")).select(F.col("id").alias("conversation_id"))
    return T.messages(spark, sf).join(live, "conversation_id", "left_semi").orderBy("conversation_id", "seq")


@query(sql("SELECT conversation_id, substr(arg_min(content, seq), 1, 20) AS title FROM messages WHERE role = 'user' GROUP BY conversation_id"))
def conversation_titles(spark, sf):
    asked = T.messages(spark, sf).where("role = 'user'")
    return asked.groupBy("conversation_id").agg(scalars.title(F.min_by("content", "seq")).alias("title"))


@query(sql("SELECT conversation_id, count(*) AS message_count, count(*) FILTER (WHERE role = 'assistant') AS answers FROM messages GROUP BY conversation_id"))
def conversation_counts(spark, sf):
    return T.messages(spark, sf).groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query(sql("SELECT conversation_id, '# ' || conversation_id || chr(10) || string_agg(CASE role WHEN 'user' THEN '## 用户' WHEN 'assistant' THEN '## Agent' ELSE '## ' || role END || chr(10) || content, chr(10) ORDER BY seq) AS markdown FROM messages GROUP BY conversation_id"))
def conversation_transcript(spark, sf):
    head = F.when(F.col("role") == "user", "## 用户").when(F.col("role") == "assistant", "## Agent").otherwise(F.concat(F.lit("## "), F.col("role")))
    part = F.struct("seq", F.concat(head, F.lit("\n"), F.col("content")).alias("x"))
    body = F.array_join(F.array_sort(F.collect_list(part)).getField("x"), "\n")
    return T.messages(spark, sf).groupBy("conversation_id").agg(body.alias("b")).select("conversation_id", F.concat(F.lit("# "), F.col("conversation_id").cast("string"), F.lit("\n"), F.col("b")).alias("markdown"))


@query(sql("SELECT conversation_id, arg_max(content, seq) FILTER (WHERE role = 'user') AS retried, count(*) FILTER (WHERE NOT (role = 'assistant' AND seq % 5 = 3)) AS kept FROM messages GROUP BY conversation_id HAVING retried IS NOT NULL"))
def last_question(spark, sf):
    """The question that a retry asks again, and how many messages stay once answers that failed are gone."""
    return history.retried(T.messages(spark, sf).withColumn("failed", (F.col("role") == "assistant") & (F.col("seq") % 5 == 3)))


@query(sql("SELECT a.id, u.name AS user_name, a.action, a.detail FROM audit a LEFT JOIN users u ON u.id = a.user_id ORDER BY a.id DESC LIMIT 50 OFFSET 50"))
def audit_page(spark, sf):
    known = T.users(spark, sf).select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    own = directory.page(T.audit(spark, sf).select("id", "user_id", "action", "detail"), [F.desc("id")], number=2, size=50)
    return own.join(known, "user_id", "left").select("id", "user_name", "action", "detail")


@query(sql("SELECT action, count(*) AS n, count(DISTINCT user_id) AS n_users FROM audit GROUP BY action"))
def audit_action_counts(spark, sf):
    return T.audit(spark, sf).groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(sql("SELECT id, CASE WHEN left(x, 1) IN ('=', '+', '-', '@') THEN '''' || x ELSE x END AS cell FROM (SELECT id, CASE id % 4 WHEN 0 THEN '=' WHEN 1 THEN '@' ELSE '' END || action AS x FROM audit WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-12')"))
def audit_time_range_csv(spark, sf):
    mark = F.when(F.col("id") % 4 == 0, "=").when(F.col("id") % 4 == 1, "@").otherwise("")
    within = T.audit(spark, sf).where("created_at >= timestamp_ntz'2024-01-10' and created_at < timestamp_ntz'2024-01-12'")
    return within.select("id", scalars.csv_guarded(F.concat(mark, F.col("action"))).alias("cell"))


@query(sql("""SELECT id, CASE id % 4 WHEN 0 THEN 'k=' || tokens || ' · user=' || user_id WHEN 1 THEN 'not json ' || id WHEN 2 THEN NULL ELSE 'k=' || tokens END AS label FROM audit"""))
def audit_detail_label(spark, sf):
    """Details with two entries, with one, that are no JSON, and none."""
    k, who, kind = F.col("tokens").cast("string"), F.col("user_id").cast("string"), F.col("id") % 4
    detail = F.when(kind == 0, F.concat(F.lit('{"k":'), k, F.lit(',"user":"'), who, F.lit('"}'))).when(kind == 1, F.concat(F.lit("not json "), F.col("id").cast("string"))).when(kind == 3, F.col("detail"))
    return T.audit(spark, sf).select("id", scalars.detail_label(detail).alias("label"))


@query(sql("SELECT strftime(created_at, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS active_users FROM audit GROUP BY day"))
def stats_active_users(spark, sf):
    return T.audit(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("active_users"))


@query(sql("SELECT app_id, count(*) AS n_conversations, sum(last_seq + 1)::BIGINT AS n_messages FROM talks GROUP BY app_id ORDER BY n_messages DESC, app_id LIMIT 5"))
def stats_hot_apps(spark, sf):
    own = T.conversations(spark, sf).groupBy("app_id").agg(F.count("*").alias("n_conversations"), F.sum(F.col("last_seq") + 1).alias("n_messages"))
    return own.orderBy(F.desc("n_messages"), "app_id").limit(5)


@query(sql("SELECT u.dept_id, strftime(a.created_at, '%Y-%m') AS month, sum(a.tokens)::BIGINT AS tokens, sum(a.tokens) > 20000 AS over_quota FROM audit a JOIN users u ON u.id = a.user_id GROUP BY u.dept_id, month"))
def stats_monthly_quota(spark, sf):
    who = T.users(spark, sf).select(F.col("id").alias("user_id"), "dept_id")
    own = T.audit(spark, sf).join(who, "user_id").groupBy("dept_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.sum("tokens").alias("tokens"))
    return own.withColumn("over_quota", F.col("tokens") > 20000)


@query(sql("SELECT user_id, strftime(created_at, '%Y-%m') AS month, sum(tokens)::BIGINT AS tokens, sum(tokens) > 3000 AS over_quota FROM audit GROUP BY user_id, month"))
def stats_user_quota(spark, sf):
    own = T.audit(spark, sf).groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.sum("tokens").alias("tokens"))
    return own.withColumn("over_quota", F.col("tokens") > 3000)


@query(sql("SELECT count(*) AS total FROM audit WHERE action = 'view' AND user_id < 50 AND created_at >= TIMESTAMP '2024-01-10'"))
def audit_total(spark, sf):
    return T.audit(spark, sf).where("action = 'view' and user_id < 50 and created_at >= timestamp_ntz'2024-01-10'").agg(F.count("*").alias("total"))


@query(sql("SELECT action, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95 FROM audit GROUP BY action"))
def stats_latency_percentiles(spark, sf):
    return T.audit(spark, sf).groupBy("action").agg(F.round(F.percentile("latency", 0.5), 4).alias("p50"), F.round(F.percentile("latency", 0.95), 4).alias("p95"))


@query(sql("SELECT strftime(created_at, '%Y-%m-%d') AS day, round(avg(CASE WHEN action <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM audit GROUP BY day"))
def stats_success_rate(spark, sf):
    ok = F.when(F.col("action") != "error", 1.0).otherwise(0.0)
    return T.audit(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg(ok), 6).alias("success_rate"))


@query(sql("SELECT user_id, count(*) FILTER (WHERE tokens % 2 = 0) AS up, count(*) FILTER (WHERE tokens % 2 = 1) AS down FROM audit GROUP BY user_id"))
def stats_feedback(spark, sf):
    return T.audit(spark, sf).groupBy("user_id").agg(F.count_if(F.col("tokens") % 2 == 0).alias("up"), F.count_if(F.col("tokens") % 2 == 1).alias("down"))


@query(sql("""SELECT user_id, minute, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 1 MINUTE, created_at) AS minute, unnest(range(1 + 15 * (tokens % 6))) AS i FROM audit) GROUP BY user_id, minute HAVING count(*) > 60"""))
def rate_limit_breaches(spark, sf):
    """Minutes in which a user made more than 60 requests; an audit row stands for up to 76 of them."""
    asked = T.audit(spark, sf).select("user_id", "created_at", F.explode(F.sequence(F.lit(0).cast("long"), 15 * (F.col("tokens") % 6))))
    return limits.breaches(asked, "created_at", "1 minute", 60).select("user_id", F.col("start").alias("minute"), "n")


@query("SELECT source, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars, min(doc_id) AS first_doc FROM documents GROUP BY source")
def corpus_catalog(spark, sf):
    return T.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE text ILIKE '%tion%' AND lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 20")
def corpus_keyword_page(spark, sf):
    found = T.table(spark, sf, "documents").where(F.col("text").ilike("%tion%") & (F.col("lang") == "en")).select("doc_id", "source", "n_chars")
    return directory.page(found, [F.col("doc_id")], number=2, size=20)


@query("""SELECT doc_id, source, CASE n_chars % 3 WHEN 0 THEN '已完成' WHEN 1 THEN '索引中' ELSE '失败（no memory left on this n）' END AS status, n_chars % 3 <> 1 AS finished, count(*) OVER () AS total FROM documents WHERE lower(source) LIKE '%1%' AND lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 20""")
def corpus_documents_status(spark, sf):
    """A page of a corpus' documents with their indexing status, by keyword, and how many there are."""
    kind = F.col("n_chars") % 3
    status = F.when(kind == 0, "completed").when(kind == 1, "indexing").otherwise("error")
    error = F.when(kind == 2, "no memory left on this node")
    docs = T.table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "source", scalars.status_label(status, error).alias("status"), scalars.is_finished(status).alias("finished"))
    return corpus.filter_then_page(docs, "doc_id", F.col("source").ilike("%1%"), number=2, size=20)


@query("SELECT page_id % 7 AS k, sum(octet_length(encode(url)) + 1)::BIGINT AS bytes, 0::BIGINT AS expired FROM pages WHERE url IS NOT NULL GROUP BY k")
def files_listed(spark, sf):
    """Urls written to a folder a kind, and what a listing tells of the files: bytes, and how many are past their time."""
    path = f"{shared_dir(spark)}/urls-{uuid.uuid4().hex}"
    T.table(spark, sf, "pages").where("url is not null").select((F.col("page_id") % 7).alias("k"), F.col("url").alias("value")).write.partitionBy("k").text(path)
    found = files.listing(spark, f"{path}/k=*/*.txt").withColumn("k", F.regexp_extract("path", "/k=(\\d+)/", 1).cast("long"))
    old = limits.expired(found, "modified", F.current_timestamp()).groupBy("k").agg(F.count("*").alias("expired"))
    return found.groupBy("k").agg(F.sum("size").alias("bytes")).join(old, "k", "left").select("k", "bytes", F.coalesce("expired", F.lit(0)).cast("long").alias("expired"))


@query(sql("SELECT d.doc_id, d.source FROM documents d WHERE substr(d.source, 4)::BIGINT IN (SELECT resource_id FROM visible WHERE user_id = 7)"))
def corpus_tenant_filter(spark, sf):
    users, *rest = _access(spark, sf)
    seen = access.visible(users.where("id = 7"), *rest).select("resource_id")
    docs = T.table(spark, sf, "documents").select("doc_id", "source").withColumn("resource_id", F.expr("cast(substring(source, 4) as bigint)"))
    return docs.join(seen, "resource_id", "left_semi").select("doc_id", "source")


LEXICAL = "the ertion hand thesst outhe"


@query(f"""WITH q AS (SELECT DISTINCT unnest(string_split('{LEXICAL}', ' ')) AS w), d AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS ws FROM documents),
  s AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM d), c AS (SELECT d.doc_id, len(d.ws) AS n, q.w, len(list_filter(d.ws, lambda x: x = q.w)) AS c FROM d, q),
  f AS (SELECT w, count(*) FILTER (WHERE c > 0) AS df FROM c GROUP BY w),
  r AS (SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM c JOIN f USING (w), s GROUP BY doc_id)
  SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def corpus_retrieve_lexical(spark, sf):
    return corpus.lexical(T.table(spark, sf, "documents"), LEXICAL)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def corpus_retrieve_vector(spark, sf):
    vectors = T.table(spark, sf, "embeddings")
    return corpus.vector(vectors.select("vec_id", "embedding"), vectors.where("vec_id = 0").select(F.col("embedding").alias("q")))


_TOKENS = """tokens AS (SELECT id, user_id, CASE WHEN action = 'error' THEN created_at END AS revoked_at, created_at + INTERVAL 7 DAY AS expires_at FROM audit)"""


def _tokens(spark, sf):
    made = F.col("created_at")
    return T.audit(spark, sf).select("id", "user_id", F.when(F.col("action") == "error", made).alias("revoked_at"), (made + F.expr("interval 7 days")).alias("expires_at"))


@query(sql(f"SELECT * FROM (WITH {_TOKENS} SELECT t.id, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at < TIMESTAMP '{CLOCK}' THEN 'expired' WHEN coalesce(u.status, 0) <> 1 THEN 'inactive_user' ELSE 'valid' END AS state FROM tokens t LEFT JOIN users u ON u.id = t.user_id)"))
def token_states(spark, sf):
    return tokens.states(_tokens(spark, sf), T.users(spark, sf), F.expr(f"timestamp_ntz'{CLOCK}'")).select("id", "state")


@query(sql(f"SELECT * FROM (WITH {_TOKENS} SELECT id, CASE WHEN revoked_at IS NULL AND user_id % 10 = 0 THEN TIMESTAMP '{CLOCK}' ELSE revoked_at END AS revoked_at FROM tokens)"))
def tokens_revoked(spark, sf):
    who = T.users(spark, sf).where("id % 10 = 0").select(F.col("id").alias("user_id"))
    return tokens.revoked_of(_tokens(spark, sf), who, F.expr(f"timestamp_ntz'{CLOCK}'")).select("id", "revoked_at")


@query(r"""SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_extract(replace(url, '\', '/'), '[^/]*$'), '[^A-Za-z0-9._\x{4e00}-\x{9fff}-]', '_', 'g'), '^\.+', ''), 120), ''), 'file') AS name FROM pages""")
def filename_sanitize(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", scalars.safe_filename(F.col("url")).alias("name"))


@query("SELECT doc_id, CASE WHEN coalesce(n_chars, 0) <= 0 THEN '0 B' WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars * 10 / 1048576.0 + 0.5) / 10) END AS label FROM documents")
def size_label(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", scalars.size_label(F.col("n_chars")).alias("label"))


@query(f"SELECT event_id, CASE WHEN date_diff('day', ts, TIMESTAMP '{CLOCK}') = 0 THEN strftime(ts, '%H:%M') WHEN date_diff('day', ts, TIMESTAMP '{CLOCK}') < 7 THEN date_diff('day', ts, TIMESTAMP '{CLOCK}') || ' 天前' ELSE strftime(ts, '%m-%d') END AS label FROM events")
def relative_times(spark, sf):
    return T.table(spark, sf, "events").select("event_id", scalars.relative_time(F.col("ts"), F.expr(f"timestamp_ntz'{CLOCK}'")).alias("label"))


@query("SELECT user_id, sha256(user_id::VARCHAR) AS token_hash FROM (SELECT DISTINCT user_id FROM events)")
def token_hashes(spark, sf):
    return T.table(spark, sf, "events").select("user_id").distinct().select("user_id", F.sha2(F.col("user_id").cast("string"), 256).alias("token_hash"))
