"""Operators on the small cases that define them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gatehouse.functions import scalars
from gatehouse.operators import access, directory, tokens, turns, workflows
from gatehouse.plans.registry import ORACLE_SQL, QUERIES
from gatehouse.sources import tables as T

GRANT = "resource_id long, principal_type string, principal_id long"


@pytest.mark.parametrize(
    ("grants", "wanted"),
    [
        ([(3, "user", 9)], [3]),
        ([(2, "dept", 5)], [2]),
        ([(1, "role", 4)], [1]),
        ([(3, "user", 9), (2, "dept", 5), (1, "role", 4), (1, "user", 9)], [1, 2, 3]),
        ([(3, "user", 8), (2, "dept", 1), (1, "role", 3)], []),
        ([(6, "user", 9)], []),
    ],
)
def test_visible(spark, grants, wanted):
    users = spark.createDataFrame([(9, 5, 1, None), (1, None, 1, None), (2, 5, 0, None), (3, None, 1, '["PLATFORM_ADMIN"]'), (4, None, 1, '["PLATFORM_ADMIN"]')], "id long, dept_id long, status int, roles_json string")
    roles = spark.createDataFrame([(4, "A"), (8, "PLATFORM_ADMIN")], "id long, code string")
    resources = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (6, 0)], "id long, status int")
    held = spark.createDataFrame([(9, 4), (1, 8), (2, 8), (4, 4)], "user_id long, role_id long")
    tables = (users, held, spark.createDataFrame(grants, GRANT), resources, roles)
    got = access.visible(*tables).collect()
    assert sorted(r.resource_id for r in got if r.user_id == 9) == wanted
    assert sorted(r.resource_id for r in got if r.user_id == 1) == [1, 2, 3]
    assert not [r for r in got if r.user_id == 2]
    # By the snapshot only where there is no role row.
    assert sorted(r.resource_id for r in got if r.user_id == 3) == [1, 2, 3] and not [r for r in got if r.user_id == 4 and grants != [(1, "role", 4)] and (1, "role", 4) not in grants]
    assert sorted(tuple(r)[:2] for r in access.scopes(*tables).where("unrestricted").collect()) == [(1, None), (3, None)]
    asked = spark.createDataFrame([(9, r) for r in (1, 2, 3, 6, 77)] + [(1, 2), (3, 3), (2, 1), (None, 1), (9, None)], "user_id long, resource_id long")
    told = {(r.user_id, r.resource_id): r.outcome for r in access.decided(asked, *tables).collect()}
    assert told == {(9, r): "allow" if r in wanted else "deny" for r in (1, 2, 3)} | {(9, 6): "inactive", (9, 77): "not_found", (1, 2): "allow", (3, 3): "allow", (2, 1): "inactive", (None, 1): "inactive", (9, None): "not_found"}


def test_grants_change(spark):
    grants = spark.createDataFrame([(1, "user", 9), (2, "user", 9), (2, "dept", 5)], GRANT)
    after, added = access.upserted(grants, spark.createDataFrame([(1, "user", 9), (4, "user", 9), (4, "user", 9)], GRANT))
    assert (after.count(), added.count()) == (4, 1)
    resources = spark.createDataFrame([(1, 1), (5, 1)], "id long, status int")
    of = (F.col("principal_type") == "user") & (F.col("principal_id") == 9)
    got = access.replaced(grants, of, spark.createDataFrame([(5, "user", 9), (5, "user", 9)], GRANT), resources)
    assert sorted(map(tuple, got.collect())) == [(2, "dept", 5, "replaced"), (5, "user", 9, "replaced")]
    refused = access.replaced(grants, of, spark.createDataFrame([(5, "user", 9), (77, "user", 9)], GRANT), resources)
    assert sorted(map(tuple, refused.collect())) == [(1, "user", 9, "unknown: 1 from 77"), (2, "dept", 5, "unknown: 1 from 77"), (2, "user", 9, "unknown: 1 from 77")]


def test_department_moves(spark):
    tree = directory.with_paths(spark.createDataFrame([(1, "A", None), (2, "B", None), (3, "C", 1), (4, "D", 3), (10, "E", None)], "id long, name string, parent_id long"))
    assert {r.id: r.path for r in tree.collect()} == {1: "/1/", 2: "/2/", 3: "/1/3/", 4: "/1/3/4/", 10: "/10/"}
    after = {r.id: r.path for r in directory.moved(tree, 3, 2).collect()}
    assert (after[3], after[4], after[1]) == ("/2/3/", "/2/3/4/", "/1/")
    assert {r.outcome for r in directory.moved(tree, 1, 4).collect()} == {"cycle"}
    assert {r.outcome for r in directory.moved(tree, 1, 99).collect()} == {"unknown_parent"}
    assert {r.outcome for r in directory.moved(tree, 1, 1).collect()} == {"self_parent"}
    for parent in (None, 2, 98):
        assert {(r.id, r.path, r.outcome) for r in directory.moved(tree, 77, parent).collect()} == {(r.id, r.path, "not_found") for r in tree.collect()}
    assert {r.id: r.path for r in directory.moved(tree, 3, None).collect()}[4] == "/3/4/"
    assert sorted((r.id, r.ancestor_id) for r in directory.ancestors(tree).where("id = 4").collect()) == [(4, 1), (4, 3), (4, 4)]


def test_frames_and_turns(spark):
    lines = ["event: message\r", 'data: {"answer":', 'data: "Hello"}', "", 'data: {"event":"message","answer":"x","reasoning_content":"why"}', "", 'data: {"event":"agent_thought","thought":""}', "", 'data: {"event":"message_end","conversation_id":"c","metadata":{"usage":{"total":0,"total_tokens":5}}}']
    raw = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "stream_id long, seq long, line string")
    frames = turns.split_frames(raw)
    assert [(r.event, r.data.count("\n")) for r in frames.orderBy("seq").collect()] == [("message", 1), (None, 0), (None, 0), (None, 0)]
    events = turns.translate_chat(frames)
    assert [r.event for r in events.orderBy("seq", "sub_seq").collect()] == ["message", "reasoning", "message", "message_end"]
    row = turns.fold(events).collect()[0]
    assert (row.content, row.reasoning, row.total_tokens, row.upstream_id, row.failed) == ("Hellox", "why", 0, "c", 0)


def test_closing_events(spark):
    rows = turns.closed(spark.createDataFrame([(1, "normal"), (2, "http_500"), (3, "client_abort"), (4, "timeout")], "stream_id long, reason string"))
    assert sorted((r.stream_id, r.event) for r in rows.collect()) == [(1, "agent_done"), (2, "agent_done"), (2, "error"), (4, "agent_done"), (4, "error")]


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (scalars.redacted, "", "workflow failed"),
        (scalars.redacted, "x" * 500, "x" * 200),
        (scalars.redacted, "see http://a/b?c=d\n" + "y" * 130 + "\n short ", "see [url] short"),
        (scalars.safe_filename, "../../../../etc/passwd", "passwd"),
        (scalars.safe_filename, "C:\\tmp\\报告 v1.pdf", "报告_v1.pdf"),
        (scalars.safe_filename, "...", "file"),
        (scalars.safe_extension, "a.TXT", "txt"),
        (scalars.safe_extension, "noext", "bin"),
        (scalars.mime_kind, "image/png", "image"),
        (scalars.mime_kind, "text/csv", "generic"),
        (scalars.mime_class, "Image/PNG; q=1", "image"),
        (scalars.stripped, "\u3000 a b\t", "a b"),
        (scalars.title, "😀" * 30, "😀" * 20),
        (scalars.csv_guarded, "=1+1", "'=1+1"),
        (scalars.detail_label, '{"a":"b","c":1}', "a=b · c=1"),
        (scalars.detail_label, "oops", "oops"),
    ],
)
def test_scalars(spark, function, given, wanted):
    assert spark.createDataFrame([(given,)], "x string").select(function(F.col("x"))).first()[0] == wanted


def test_more_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.size_label(F.lit(1536))) == "1.5 KB" and one(scalars.size_label(F.lit(-1))) == "0 B"
    assert one(scalars.first_missing(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(" ")))) == "b"
    assert one(scalars.stale(F.lit("1"), F.lit("2"))) is True and one(scalars.stale(F.lit("dev"), F.lit("2"))) is False
    assert one(scalars.epoch_time(F.lit(1_700_000_000))) == one(scalars.epoch_time(F.lit(1_700_000_000_000)))
    assert one(scalars.upstream_outcome(F.lit(404), F.lit('{"message":"gone"}'))) == "404 gone"
    assert one(scalars.upstream_outcome(F.lit(500), F.lit("boom"))) == "502 HTTP 500"


def test_token_states(spark):
    users = spark.createDataFrame([(1, 1), (2, 0)], "id long, status int")
    rows = [(1, 1, None, 9), (2, 1, 1, 9), (3, 1, None, 2), (4, 2, None, 9), (5, 7, None, 9)]
    states = tokens.states(spark.createDataFrame(rows, "id long, user_id long, revoked_at long, expires_at long"), users, F.lit(5))
    assert {r.id: r.state for r in states.collect()} == {1: "valid", 2: "revoked", 3: "expired", 4: "inactive_user", 5: "inactive_user"}


def test_missing_principals_and_guards(spark):
    users = spark.createDataFrame([(7, "u7", 3), (9, "u9", None)], "id long, name string, dept_id long")
    departments = spark.createDataFrame([(1, "A", None), (2, "B", 1), (3, "C", None), (4, "D", None)], "id long, name string, parent_id long")
    roles = spark.createDataFrame([(4, "ADMIN")], "id long, code string")
    held = [(1, "user", 7), (1, "user", 8), (2, "dept", 3), (2, "dept", 7), (3, "role", 4), (3, "role", 9)]
    gone = access.orphaned(spark.createDataFrame(held, GRANT), access.names(users, departments, roles))
    assert sorted((r.resource_id, r.principal_type, r.principal_id) for r in gone.collect()) == [(1, "user", 8), (2, "dept", 7), (3, "role", 9)]
    assert {r.id: r.outcome for r in directory.delete_guard(departments, users).collect()} == {1: "has_children", 2: "ok", 3: "has_users", 4: "ok"}


def test_queries_over_all_users(spark):
    sf = "/root/testdata/sf0.001"
    users = T.users(spark, sf)
    ids, depts = {r.id for r in users.select("id").collect()}, {r.dept_id for r in users.select("dept_id").collect()}
    assert not [r for r in QUERIES["grants_orphaned"](spark, sf).where("principal_type = 'user'").collect() if r.principal_id in ids]
    assert not [r for r in QUERIES["dept_delete_guard"](spark, sf).where("outcome = 'ok'").collect() if r.id in depts]
    page = QUERIES["audit_page"](spark, sf).join(T.audit(spark, sf).select("id", "user_id"), "id").collect()
    assert page and all((r.user_name is not None) == (r.user_id in ids) for r in page)


def test_names_labels_and_reasons_of_all_rows(spark, tmp_path):
    long = "a" * 130
    pages = [(1, "http://a/b c?q=1#x"), (2, "http://a/..hidden"), (3, f"http://a/{long}"), (4, "http://a/"), (5, "http://a/报告.pdf"), (6, None), (7, "a/b\\c.txt")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = [(1, None, None), (2, "", 0), (3, "see https://a/b?c now\r\n\u3000x \n\n" + "y" * 121, 1536), (4, "z" * 300, 3 << 20), (5, " \u2003 ", 1048576), (6, "ab\rc", 1023)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {
        "filename_sanitize": {1: "b_c_q_1_x", 2: "hidden", 3: "a" * 120, 4: "file", 5: "报告.pdf", 6: "file", 7: "c.txt"},
        "size_label": {1: "0 B", 2: "0 B", 3: "1.5 KB", 4: "3.0 MB", 5: "1.0 MB", 6: "1023 B"},
        "error_redact": {1: "workflow failed", 2: "workflow failed", 3: "see [url] now x", 4: "z" * 200, 5: "workflow failed", 6: "ab c"},
    }
    db = duckdb.connect()
    for name in ("pages", "documents"):
        db.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name, rows in wanted.items():
        assert dict(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == rows, name
        assert dict(db.sql(ORACLE_SQL[name]).fetchall()) == rows, name


def test_workflow_graphs(spark):
    graphs = {
        "ok": ("s1 l2 a3", "12 23"),
        "starts": ("s1 s2 a3", "13 23"),
        "no_answer": ("s1 l2", "12"),
        "start_open": ("s1 a2", ""),
        "dead_end": ("s1 l2 a3", "12 22"),
        "branches": ("s1 i2 a3", "12 23t"),
        "dead_branch": ("s1 i2 a3 l4", "12 23t 24f"),
        "orphans": ("s1 a2 l3", "12 32"),
    }
    kinds = {"s": "start", "l": "llm", "a": "answer", "i": "if-else"}
    nodes = [(g, int(x[1]), kinds[x[0]]) for g, (n, _) in graphs.items() for x in n.split()]
    edges = [(g, int(e[0]), int(e[1]), {"t": "true", "f": "false"}.get(e[2:])) for g, (_, x) in graphs.items() for e in x.split()]
    got = workflows.validated(spark.createDataFrame(nodes, "graph_id string, node_id long, kind string"), spark.createDataFrame(edges, "graph_id string, source long, target long, handle string"))
    assert {r.graph_id: r.outcome for r in got.collect()} == {g: g for g in graphs}


def test_page_states(spark):
    rows = [
        (1, 1, "message", '{"answer":"a"}'), (1, 2, "error", '{"message":"boom"}'), (1, 3, "message", '{"answer":5}'), (1, 4, "agent_done", "{}"),
        (2, 1, "message", '{"answer":"a"}'), (2, 2, "error", '{"message":"boom"}'),
        (3, 1, "message", '{"answer":7}'), (3, 2, "message", '{"answer":null}'), (3, 3, "message", '{"answer":true}'),
        (4, 1, "error", "no JSON"), (5, 1, "error", '{"message":"x"}'), (6, 1, "message", '{"answer":"part"}'), (7, 1, "message", '{"answer":"part"}'),
    ]
    events = spark.createDataFrame([(s, q, 1, e, d, "x") for s, q, e, d in rows], "stream_id long, seq long, sub_seq int, event string, data string, parsed string")
    closes = spark.createDataFrame([(1, "normal"), (2, "client_abort"), (3, "normal"), (4, "normal"), (5, "timeout"), (6, "client_abort"), (7, "connection_lost"), (8, "normal")], "stream_id long, reason string")
    got = {r.stream_id: (r.status, r.content) for r in turns.states(events, closes).collect()}
    assert got == {
        1: ("error", "boom5"), 2: ("done", "boom"), 3: ("done", "7true"), 4: ("error", turns.NO_REASON), 5: ("error", "Upstream timeout"), 6: ("done", "part"), 7: ("error", turns.BROKEN), 8: ("done", ""),
    }


def test_answers_of_any_scalar_are_kept(spark):
    rows = [(1, '{"event":"message","answer":5}'), (2, '{"event":"message","answer":"a"}'), (3, '{"event":"message","answer":null}'), (4, '{"event":"message","answer":false}'), (5, '{"event":"message"}'), (6, '{"event":"message","answer":[1]}'), (7, "[]")]
    frames = spark.createDataFrame([(1, s, None, d, 3, "n") for s, d in rows], "stream_id long, seq long, event string, data string, said int, parsed string")
    events = turns.translate_chat(frames)
    assert events.columns == ["stream_id", "seq", "sub_seq", "event", "data", "said", "parsed"]
    assert [r.content for r in turns.fold(events).collect()] == ["5aNoneFalse[1]"] == [r.content for r in turns.folded(turns.translated(frames.drop("said"))).collect()]


def test_repeats_have_a_rule(spark):
    users = spark.createDataFrame([("a@b", 0), ("a@b", 1), ("c@d", 0)], "email string, status int")
    got = tokens.eligible(spark.createDataFrame([("a@b",), ("c@d",), ("A@b",)], "email string"), users)
    assert sorted(map(tuple, got.collect())) == [("A@b", "unknown"), ("a@b", "ok"), ("c@d", "inactive")]
    held = spark.createDataFrame([(2, 1, None, 9, "h"), (1, 1, 3, 9, "h")], "id long, user_id long, revoked_at long, expires_at long, token_hash string")
    known = spark.createDataFrame([(1, 1)], "id long, status int")
    assert [r.state for r in tokens.asked(spark.createDataFrame([("h",)], "token_hash string"), held, known, F.lit(5)).collect()] == ["revoked"]
    assert tokens.revoked_of(held.withColumn("hit", F.lit(0)), known.select(F.col("id").alias("user_id")), F.lit(5).cast("long")).where("revoked_at = 5 and hit = 0").count() == 1


def test_snapshots_follow_roles(spark):
    users = spark.createDataFrame([(1, "[]"), (2, None)], "id long, roles_json string")
    roles = spark.createDataFrame([(1, "A"), (2, "B")], "id long, code string")
    after = lambda codes: {r.id: r.roles_json for r in access.snapshot_replaced(users, 2, codes, roles).collect()}
    assert after(["B", "A", "B"]) == {1: "[]", 2: '["B","A","B"]'} and after(["B", "Z"]) == {1: "[]", 2: None} and after([]) == {1: "[]", 2: "[]"}
