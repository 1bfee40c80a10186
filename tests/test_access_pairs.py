"""Access by kinds of users: what is counted isn't written out, what is written out isn't shuffled."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gatehouse.operators import access, blocks
from gatehouse.plans.registry import QUERIES
from gatehouse.sources import tables as T


def shuffled(spark) -> int:
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture(scope="module")
def crowd(spark):
    """2,000 users of one department and role, every hundredth an administrator, and 1,000 resources that both are granted."""
    users = spark.range(2000).select("id", F.lit(5).cast("long").alias("dept_id"), F.lit(1).alias("status"))
    held = users.select(F.col("id").alias("user_id"), F.lit(4).cast("long").alias("role_id")).unionByName(users.where("id % 100 = 0").select(F.col("id").alias("user_id"), F.lit(8).cast("long").alias("role_id")))
    resources = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("status"))
    grants = resources.select(F.col("id").alias("resource_id"), F.explode(F.array(F.struct(F.lit("dept").alias("t"), F.lit(5).alias("i")), F.struct(F.lit("role").alias("t"), F.lit(4).alias("i")), F.struct(F.lit("user").alias("t"), F.lit(7).alias("i")))).alias("g")).select("resource_id", F.col("g.t").alias("principal_type"), F.col("g.i").cast("long").alias("principal_id"))
    roles = spark.createDataFrame([(4, "A"), (8, "PLATFORM_ADMIN")], "id long, code string")
    return users, held, grants, resources, roles


@pytest.mark.parametrize(("name", "rows"), [("access_reach", 1000), ("access_admin_bypass", 20), ("access_default_closed", 0), ("access_scopes", 1980 * 900 + 20), ("access_visible_resources", 2000 * 900)])
def test_no_pair_is_shuffled(spark, crowd, monkeypatch, name, rows):
    for table, given in zip(("users", "user_roles", "grants", "resources", "roles"), crowd, strict=True):
        monkeypatch.setattr(T, table, lambda spark, sf, given=given: given)
    before = shuffled(spark)
    rows_seen = spark.sparkContext.accumulator(0)
    QUERIES[name](spark, "").foreachPartition(lambda part: rows_seen.add(sum(1 for _ in part)))
    assert rows_seen.value == rows
    assert shuffled(spark) - before < 1_000_000


@pytest.mark.parametrize("name", ["access_visible_resources", "my_apps", "corpus_tenant_filter"])
def test_written_out_lists_are_never_broadcast(spark, name):
    """Copies of a list for each deal are many times what Spark reckons, which the driver would have to hold."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # The only joins on what is dealt out are merges.
    assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and ("part#" in x or "deal#" in x)]
    assert [x for x in plan.split("\n") if "SortMergeJoin" in x and "deal#" in x]


def test_numbers_equal_pairs(spark):
    """Users of many kinds, overlapping grants, inactive ones, repeated rows, grants to unknown users."""
    users = spark.range(60).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("dept_id"), F.when(F.col("id") % 11 == 0, 0).otherwise(1).alias("status"))
    held = spark.range(240).select((F.col("id") % 50).alias("user_id"), F.when(F.col("id") % 31 > 0, F.col("id") % 4).alias("role_id")).unionByName(spark.createDataFrame([(3, 9), (11, 9), (99, 9)], "user_id long, role_id long"))
    resources = spark.range(30).select("id", F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("status"))
    kind = F.element_at(F.array(F.lit("user"), F.lit("dept"), F.lit("role")), (F.col("id") % 3 + 1).cast("int"))
    grants = spark.range(90).select((F.col("id") * 7 % 30).alias("resource_id"), kind.alias("principal_type"), F.when(kind == "user", F.col("id") * 13 % 70).otherwise(F.col("id") % 5 % 3).alias("principal_id"))
    roles = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "D"), (9, "PLATFORM_ADMIN")], "id long, code string")
    tables = users, held, grants.unionByName(grants), resources, roles
    people, open_ = {r.id: r for r in users.where("status = 1").collect()}, {r.id for r in resources.where("status = 1").collect()}
    of = {u: {("user", u), ("dept", r.dept_id)} | {("role", h.role_id) for h in held.collect() if h.user_id == u} for u, r in people.items()}
    given = {(r.resource_id, (r.principal_type, r.principal_id)) for r in grants.collect()}
    wanted = {(u, r) for u in people for r in open_ if ("role", 9) in of[u] or any((r, p) in given for p in of[u] if p[1] is not None)}
    pairs = [tuple(r) for r in access.visible(*tables).collect()]
    assert len(pairs) == len(wanted) and set(pairs) == wanted
    assert {r.resource_id: r.n_users for r in access.reach(*tables).collect()} == {r: sum(x == r for _, x in wanted) for r in range(30)}
    assert {r.user_id: r.n_resources for r in access.counted(*tables).collect()} == {u: sum(x == u for x, _ in wanted) for u in {x for x, _ in wanted}}
    assert {r.user_id for r in access.closed(*tables).collect()} == people.keys() - {u for u, _ in wanted}
    none = users, held, grants, resources.where("false"), roles
    assert {r.user_id for r in access.closed(*none).collect()} == people.keys() and not access.counted(*none).collect()


def stored(df, path) -> float:
    """Bytes a row of df as files."""
    df.write.parquet(path)
    return sum(f.stat().st_size for f in Path(path).glob("*.parquet")) / df.sparkSession.read.parquet(path).count()


@pytest.mark.parametrize("of", [access.scopes, access.visible])
def test_stored_pairs_are_runs_that_repeat(spark, tmp_path, of):
    """250 users of one department that is granted 40,000 resources: what is stored grows with runs and how often they repeat; two ids take sixteen bytes."""
    users = spark.range(250).select("id", F.lit(5).cast("long").alias("dept_id"), F.lit(1).alias("status"))
    resources = spark.range(40_000).select("id", F.lit(1).alias("status"))
    grants = resources.select(F.col("id").alias("resource_id"), F.lit("dept").alias("principal_type"), F.lit(5).cast("long").alias("principal_id"))
    held = spark.createDataFrame([(1, 4)], "user_id long, role_id long")
    roles = spark.createDataFrame([(4, "A"), (8, "PLATFORM_ADMIN")], "id long, code string")
    assert stored(of(users, held, grants, resources, roles), str(tmp_path / "pairs")) < 0.5


def test_lists_of_any_length_give_each_pair_once(spark, monkeypatch):
    """Lists below, at and above their bounds, with nulls, repeated ids and keys of one side only."""
    monkeypatch.setattr(blocks, "LIST", 20)
    monkeypatch.setattr(blocks, "RUN", 8)
    one = [(k, i) for k in range(25) for i in range(k)] + [(24, None), (3, 1), (None, 5)]
    other = [(k, i) for k in range(1, 45) for i in range(k)] + [(24, 3), (24, None)]
    ones = blocks.lists(spark.createDataFrame(one, "k long, a long"), ["k"], "a", "ones")
    others = blocks.lists(spark.createDataFrame(other, "k long, b long"), ["k"], "b", "others")
    assert max(len(r.ones) for r in ones.collect()) == 20 and max(len(r.others) for r in others.collect()) == 20
    got = [tuple(r) for r in blocks.written_out(ones, others, ["k"], "a", "b", ["k"]).collect()]
    assert sorted(got, key=str) == sorted(((a, b) for k, a in one for j, b in other if k == j), key=str)
