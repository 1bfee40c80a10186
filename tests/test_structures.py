"""Trees, orders, indexes, sketches, parts and cycles against plain versions."""

import datetime
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatehouse.operators import changes, graphs, hierarchy, ordering, retrieval, sketches, workflows
from gatehouse.sources import parts

NODE = "id long, parent_id long"


def walked(parents):
    """{id: (outcome, depth, enter, leave)} by a walk with a stack."""
    below = {}
    for i, p in parents.items():
        below.setdefault(p, []).append(i)
    out, at = {}, 0
    stack = [(i, 0, False) for i in sorted(below.get(None, []), reverse=True)]
    while stack:
        i, depth, leaving = stack.pop()
        if leaving:
            out[i] = ("ok", depth, out[i][2], at)
        else:
            out[i] = ("ok", depth, at, None)
            stack.append((i, depth, True))
            stack += [(c, depth + 1, False) for c in sorted(below.get(i, []), reverse=True)]
        at += 1
    gone = [i for i, p in parents.items() if p is not None and p not in parents]
    while gone:
        i = gone.pop()
        out[i] = ("missing", None, None, None)
        gone += below.get(i, [])
    return {i: out.get(i, ("cycle", None, None, None)) for i in parents}


def test_intervals_of_trees_of_any_shape(spark):
    rng = random.Random(4)
    parents = {i: rng.choice([None, *range(1, i)][-9:]) if i > 1 else None for i in range(1, 120)}
    parents |= {200: 201, 201: 202, 202: 200, 203: 201, 204: 204, 205: 999, 206: 205, 300: None, -5: 300, -6: -5}
    parents |= {i: 1 for i in range(400, 460)}
    got = hierarchy.intervals(spark.createDataFrame(list(parents.items()), NODE).repartition(5))
    assert {r.id: tuple(r)[1:] for r in got.collect()} == walked(parents)
    places = got.where("outcome = 'ok'")
    pairs = {(r.id, r.above) for r in hierarchy.below(places, places.where("id in (1, 300, 7)"), width=16).collect()}
    place = walked(parents)
    assert pairs == {(i, a) for a in (1, 300, 7) for i, p in place.items() if p[0] == "ok" and place[a][2] <= p[2] <= place[a][3]}
    assert hierarchy.intervals(spark.createDataFrame([], NODE)).count() == 0


def test_chain_of_ten_thousand(spark):
    n = 10_000
    chain = spark.range(1, n + 1).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    got = hierarchy.intervals(chain).agg(F.count_if((F.col("depth") == F.col("id") - 1) & (F.col("enter") == F.col("id") - 1) & (F.col("leave") == 2 * n - F.col("id"))).alias("n")).first()
    assert got.n == n


def test_paths_below_a_hundred_levels(spark):
    rows = [(i, f"d{i}", i - 1 if i > 1 else None) for i in range(1, 301)] + [(500, "x", 501), (501, "y", 500), (502, "z", 500), (503, "m", 77_777)]
    got = {r.id: r.path for r in hierarchy.paths(spark.createDataFrame(rows, "id long, name string, parent_id long")).collect()}
    assert got == {i: "/" + "/".join(map(str, range(1, i + 1))) + "/" for i in range(1, 301)}


def test_places_and_neighbours(spark):
    rows = [(k % 3 if k % 7 else None, k) for k in range(500)]
    df = spark.createDataFrame(rows, "part long, within long").repartition(6)
    order = [F.col("part").asc_nulls_first(), F.col("within")]
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r)[:2] for r in sorted(ordering.placed(df, order).collect(), key=lambda r: r.place)] == wanted
    follows = {(r.part, r.within): tuple(r.next) if r.next else None for r in ordering.with_next(df, order, ["part", "within"]).collect()}
    assert follows == dict(zip(wanted, [*wanted[1:], None], strict=True))
    assert ordering.placed(df.limit(0), order).count() == 0


def plain_search(docs, queries, k):
    split = lambda t: re.split(r"\s+", t.lower())
    held = {d: split(t) for d, t in docs if t is not None}
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(w for ws in held.values() for w in set(ws))
    out = []
    for q, t in queries:
        if t is None:
            continue
        scores = {}
        for d, ws in held.items():
            s = 0.0
            for w in set(split(t)):
                c = ws.count(w)
                if c:
                    s += math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if s:
                scores[d] = round(s, 6)
        out += [(q, n + 1, d, s) for n, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize(("block", "k"), [(4, 3), (64, 10)])
def test_indexed_search_equals_a_scan(spark, tmp_path, monkeypatch, block, k):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "W0\tw1  w39"), (403, docs[5][1]), (404, docs[5][1])]
    queries = [(1, "w0 w1 W39"), (2, "w38 w37 w0 w0"), (3, "unknown"), (4, None), (5, docs[5][1]), (6, "w39")]
    own = retrieval.index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "index"), 4)
    got = retrieval.search(own, spark.createDataFrame(queries, "query_id long, text string"), k)
    assert sorted((r.query_id, r["rank"], r.doc_id, pytest.approx(r.score, abs=2e-6)) for r in got.collect()) == sorted(plain_search(docs, queries, k))


def test_texts_that_hold_a_term(spark, tmp_path):
    texts = [(1, "Ann Smith"), (2, "anna"), (3, "Zoë Ünal"), (4, ""), (5, None), (6, "a_b%c"), (7, "smithers & ann"), (8, "ab")]
    terms = [(1, "ANN"), (2, "smith%er"), (3, "n_a"), (4, "ü"), (5, ""), (6, None), (7, "xyz"), (8, "ab"), (9, "zoë ün"), (10, "ann%ann"), (11, "%")]
    df, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term_id long, term string")
    got = retrieval.containing(df, retrieval.contains_index(df, str(tmp_path / "grams"), 4), asked, 4)
    like = lambda term: re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{term.lower()}%"), re.S)
    wanted = [(t, i) for t, term in terms if term is not None for i, x in texts if x is not None and like(term).fullmatch(x.lower())]
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_statistics_merge(spark):
    rng = random.Random(1)
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k, hours=5)
    rows = [("ab"[i % 2], day(i % 9 if i % 9 < 5 else 20 + i % 9), rng.choice([None, 5, 70_000, -1 - i % 3, i % 400]), rng.gauss(0, 1) if i % 50 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "kind string, at timestamp, user long, value double")
    ranks = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    told = sketches.merged_quantiles(sketches.daily_quantiles(df, ["kind"], "at", "value"), ["kind"], ranks)
    for r in told.collect():
        own = sorted(v for k, _, _, v in rows if k == r.kind and v is not None)
        assert r.n == len(own) and all(abs(sum(x <= r[name] for x in own) / len(own) - q) < sketches.RANK_ERROR for name, q in ranks.items())
    assert all(all(r[name] for name in ranks) for r in sketches.within(df, ["kind"], "value", told, ranks).collect())
    off = told.withColumn("p50", F.col("p99"))
    assert not any(r["p50"] for r in sketches.within(df, ["kind"], "value", off, ranks).collect())
    by_day = {}
    for _, at, user, _ in rows:
        by_day.setdefault(at.date(), set()).add(user)
    for days in (1, 7):
        wanted = {d: len(set().union(*[u for e, u in by_day.items() if 0 <= (d - e).days < days]) - {None}) for d in by_day}
        assert {r.day: r.n for r in sketches.rolling_users(sketches.daily_users(df, "at", "user"), days).collect()} == wanted


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_change_leaves_other_parts_as_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"n{i}", i % 4) for i in range(200)]
    parts.create(spark.createDataFrame(rows, "id long, name string, dept long"), path, "id", 16)
    before = files_of(path)
    patches = spark.createDataFrame([(7, ["dept"], None, 9, 1), (7, ["dept", "name"], "x", 8, 2), (7, [], "no", 1, 3), (7, ["name"], None, 5, 4), (9999, ["name"], "nobody", 1, 1)], "id long, fields array<string>, name string, dept long, at int")
    hit = parts.change(spark, path, "id", patches, lambda old: changes.patched(old, patches, "id", "at"), 16)
    after = files_of(path)
    assert 1 <= len(hit) <= 2 and {f for f in before if after.get(f) != before[f]} == {f for f in before if any(f"_part={p}/" in f for p in hit)}
    wanted = {i: (n, d) for i, n, d in rows} | {7: (None, 8)}
    assert {r.id: (r.name, r.dept) for r in parts.table(spark, path).collect()} == wanted
    # All rows of a part go; a row of another part is refused, and nothing changes.
    gone = parts.table(spark, path).where(parts._part("id", 16) == hit[0]).select("id").persist()
    ids = {r.id for r in gone.collect()}
    parts.change(spark, path, "id", gone, lambda old: old.join(gone, "id", "left_anti"), 16)
    assert {r.id for r in parts.table(spark, path).collect()} == set(wanted) - ids
    with pytest.raises(ValueError, match="outside"):
        parts.change(spark, path, "id", spark.createDataFrame([(7,)], "id long"), lambda old: old.withColumn("id", F.col("id") + 1).unionByName(spark.createDataFrame([(8, "", 1), (9, "", 1)], "id long, name string, dept long")), 16)
    assert parts.change(spark, path, "id", gone.limit(0), lambda old: old, 16) == []
    assert parts.table(spark, path).count() == 200 - len(ids)


def test_patches_of_one_key_count_as_one(spark):
    table = spark.createDataFrame([(1, "a", 5, "z"), (2, "b", 6, "z")], "id long, name string, named long, patch string")
    patches = spark.createDataFrame([(1, ["name"], "c", 2), (1, ["name"], "d", 1), (1, ["named"], "no", 3)], "id long, fields array<string>, name string, at int").withColumn("named", F.lit(None).cast("long"))
    got = {r.id: tuple(r) for r in changes.patched(table, patches, "id", "at").collect()}
    assert got == {1: (1, "c", None, "z"), 2: (2, "b", 6, "z")}
    assert changes.patched(table, patches.limit(0)).count() == 2


def test_strong_components(spark):
    rng = random.Random(3)
    nodes = [(g, i) for g in "abc" for i in range(25)]
    edges = [(g, rng.randrange(25), rng.randrange(25)) for g, n in (("a", 20), ("b", 32), ("c", 60)) for _ in range(n)] + [("a", 3, 3), ("a", 3, 999)]
    n, e = spark.createDataFrame(nodes, "graph_id string, node_id long"), spark.createDataFrame(edges, "graph_id string, source long, target long")
    after = {(g, i): {i} for g, i in nodes}
    for _ in range(25):
        for g, a, b in edges:
            if (g, b) in after:
                for i in range(25):
                    if a in after[g, i]:
                        after[g, i].add(b)
    component = {(g, i): min(j for j in after[g, i] if i in after[g, j]) for g, i in nodes}
    got = {(r.graph_id, r.node_id): r.component for r in graphs.strong_components(n, e).collect()}
    assert got == component
    sizes = Counter((g, c) for (g, _), c in component.items())
    cyclic = {(g, i) for (g, i), c in component.items() if sizes[g, c] > 1 or (g, i, i) in edges}
    assert {(r.graph_id, r.node_id) for r in graphs.on_cycles(n, e).collect()} == cyclic
    assert len({c for c, k in sizes.items() if k > 1}) >= 2
    assert graphs.strong_components(n.limit(0), e.limit(0)).count() == 0


def test_strict_workflows(spark):
    nodes = spark.createDataFrame([("x", 1, "start"), ("x", 2, "llm"), ("x", 3, "answer"), ("y", 1, "start"), ("y", 2, "answer")], "graph_id string, node_id long, kind string")
    edges = spark.createDataFrame([("x", 1, 2, None), ("x", 2, 3, None), ("x", 2, 2, None), ("y", 1, 2, None)], "graph_id string, source long, target long, handle string")
    assert {r.graph_id: r.outcome for r in workflows.validated(nodes, edges).collect()} == {"x": "ok", "y": "ok"}
    assert {r.graph_id: r.outcome for r in workflows.validated(nodes, edges, strict=True).collect()} == {"x": "cycle", "y": "ok"}


def test_repeated_terms_are_looked_up_once(spark, tmp_path):
    """500 who ask for the same two terms get all they ask for, and texts are compared with terms, not with those who ask."""
    texts = spark.range(1000).select("id", F.concat(F.lit("Name 0"), F.col("id").cast("string")).alias("text"))
    asked = spark.range(500).select(F.col("id").alias("term_id"), F.when(F.col("id") % 2 == 0, "E").when(F.col("id") % 4 == 1, "NAME 0").otherwise("name 0").alias("term"))
    found = retrieval.containing(texts, retrieval.contains_index(texts, str(tmp_path / "grams")), asked)
    compared = found.where("id % 400 = 399").groupBy("term_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert len(compared) == 500 and all(r.ids == [399, 799] for r in compared)
    assert found.count() == 500_000
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: re.search(r"[A-Z]", line).start()
    at = [i for i, x in enumerate(lines) if "LIKE" in x]
    assert at
    for i in at:
        under = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and depth(lines[j]) <= depth(lines[i])), len(lines))
        assert "term_id" not in "\n".join(lines[i:under])


def test_index_gathers_postings_where_texts_are(spark, tmp_path):
    """A row a term and block, however many documents hold it: what is shuffled is the texts, once, and blocks of postings for asked terms."""
    docs = spark.range(256).select(F.col("id").alias("doc_id"), F.concat(F.lit("often w"), (F.col("id") % 3).cast("string")).alias("text"))
    own = retrieval.index(docs, str(tmp_path / "index"), 4)
    assert own.postings.count() == 4 * 256 // retrieval.BLOCK
    assert own.postings.where("term = 'often'").agg(F.sum(F.size("docs")).alias("n")).first().n == 256
    got = retrieval.search(own, spark.createDataFrame([(1, "W1 often")], "query_id long, text string"), 3)
    assert [r.doc_id for r in sorted(got.collect(), key=lambda r: r["rank"])] == [1, 4, 7]


def test_small_graphs_equal_those_of_any_size(spark, monkeypatch):
    """Graphs as rows of bits and graphs followed round by round tell the same, with repeated rows, nulls and edges to unknown nodes; small ones take no round."""
    rng = random.Random(11)
    nodes = [(g, i, rng.choice(["start", "llm", "answer", "if-else"]) if i else "start") for g in range(60) for i in range(rng.randint(1, 6))]
    nodes += [(1, 0, "start"), (61, None, "start"), (61, 1, "answer"), *[(None, i, "start") for i in range(4)]]
    edges = [(g, rng.randint(0, 6), rng.randint(0, 7), rng.choice([None, "true", "false"])) for g in range(62) for _ in range(rng.randint(0, 7))] + [(2, None, 1, None), (3, 0, 900, None), (3, 900, 0, None)]
    n = spark.createDataFrame(nodes, "graph_id long, node_id long, kind string")
    e = spark.createDataFrame(edges, "graph_id long, source long, target long, handle string")
    told = lambda strict: sorted(map(str, workflows.validated(n, e, strict).collect()))
    parts, on = lambda: sorted(map(str, graphs.strong_components(n, e).collect())), lambda: sorted(map(str, graphs.on_cycles(n, e).collect()))
    small = told(True), parts(), on()
    monkeypatch.setattr("gatehouse.operators.closures.NODES", 2)
    assert (told(True), parts(), on()) == small
    monkeypatch.undo()
    rounds = []
    monkeypatch.setattr(workflows, "reached", lambda *x: rounds.append(x))
    assert workflows.validated(n.where("graph_id < 60"), e.where("graph_id < 2"), True).count() == 60 and not rounds


def test_rounds_of_trees_broadcast_nothing_and_hold_short_texts(spark, monkeypatch):
    """What is written round by round isn't sent to the driver to be broadcast, and texts end at the next anchor."""
    plans, texts, own = [], [], hierarchy.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        held = own(df, name)
        texts.append(held.agg(F.sum(F.length("path"))).first()[0] or 0 if "path" in held.columns else 0)
        return held

    monkeypatch.setattr(hierarchy, "written", seen)
    monkeypatch.setattr(hierarchy, "STEP", 8, raising=False)
    chain = spark.range(1, 151).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    got = {r.id: r.path for r in hierarchy.paths(chain).collect()}
    assert got == {i: "/" + "/".join(map(str, range(1, i + 1))) + "/" for i in range(1, 151)}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    assert sum(texts) < sum(map(len, got.values()))


def test_stored_finds_are_runs_that_repeat(spark, tmp_path):
    """Finds of a term that many ask for: what is stored grows with runs and how often they repeat; two ids take sixteen bytes."""
    texts = spark.range(20_000).select("id", F.concat(F.lit("Name 00"), F.col("id").cast("string")).alias("text"))
    asked = spark.range(200).select(F.col("id").alias("term_id"), F.lit("00").alias("term"))
    found = retrieval.containing(texts, retrieval.contains_index(texts, str(tmp_path / "grams")), asked)
    found.write.parquet(str(tmp_path / "found"))
    assert spark.read.parquet(str(tmp_path / "found")).distinct().count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 4_000_000 * 0.5
