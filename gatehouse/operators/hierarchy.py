"""Trees kept as parents, of any depth: ends of chains, paths and intervals by pointer doubling, as many rounds as the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.operators import ordering
from gatehouse.sources.scratch import shared_dir, written

#: Levels from anchor to anchor of a path.
STEP = 64


def _doubled(links: DataFrame, sums: dict[str, str]) -> DataFrame:
    """links (id, up, stop, …) with up followed until it is null.

    stop is null, or says why an up that is null ends the chain. Each round an element takes over what
    the one that it points to has: up, stop, and the named columns, added up by an expression of a
    (its own) and b (the other's). Written tables are small as files but not as rows, so none is broadcast. A pointer to nothing ends with "missing"; what still points somewhere
    after as many rounds as the number of elements has bits runs in a cycle, with stop "cycle".
    """
    held = written(links, "chains")
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(held.count().bit_length() + 1):
        active = held.where("up is not null").alias("a")
        if active.isEmpty():
            return held
        others = [c for c in held.columns if c not in ("id", "up", "stop", *sums)]
        met = active.join(held.alias("b").hint("merge"), F.col("a.up") == F.col("b.id"), "left")
        stop = F.when(F.col("b.id").isNull(), "missing").otherwise(F.col("b.stop"))
        added = [F.when(F.col("b.id").isNull(), F.col(f"a.{c}")).otherwise(F.expr(e)).alias(c) for c, e in sums.items()]
        moved = met.select(F.col("a.id").alias("id"), F.col("b.up").alias("up"), stop.alias("stop"), *added, *[F.col(f"a.{c}").alias(c) for c in others])
        held = written(held.where("up is null").unionByName(moved).coalesce(tasks), "chains")
    return held.withColumn("stop", F.when(F.col("up").isNotNull(), "cycle").otherwise(F.col("stop")))


def depths(nodes: DataFrame) -> DataFrame:
    """(id, outcome, depth) of nodes (id, parent_id): ok with the depth below the root (0), missing (it or one above it has a parent that isn't there) or cycle (it lies on one or below one), both without depth."""
    own = nodes.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), "ok").alias("stop"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    ends = _doubled(own, {"depth": "a.depth + b.depth"})
    return ends.select("id", F.col("stop").alias("outcome"), F.when(F.col("stop") == "ok", F.col("depth")).alias("depth"))


def paths(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id, …) with path, "/1/3/7/"; those on or below a cycle, or below a missing parent, have no row.

    Chains are told apart first, so no text grows along a cycle. Every STEPth level holds anchors: texts are
    followed up to the anchor above only, then from anchor to anchor for those that something hangs from,
    and put together at the end, so long texts are neither written nor shuffled in each round.
    """
    deep = depths(nodes).where("outcome = 'ok'").select("id", "depth")
    anchor = (F.col("depth") - 1) % STEP == 0  # the parent is an anchor
    own = nodes.select("id", "parent_id").join(deep.hint("merge"), "id")
    text = F.concat(F.col("id").cast("string"), F.lit("/"))
    links = own.select("id", F.when(~anchor, F.col("parent_id")).alias("up"), F.lit(None).cast("string").alias("stop"), text.alias("path"), F.when(anchor, F.col("parent_id")).alias("top"))
    short = _doubled(links, {"path": "concat(b.path, a.path)", "top": "b.top"})
    tops = short.where("top is not null").select(F.col("top").alias("id")).distinct()
    chains = short.join(tops.hint("merge"), "id", "left_semi").select("id", F.col("top").alias("up"), F.lit(None).cast("string").alias("stop"), "path")
    whole = _doubled(chains, {"path": "concat(b.path, a.path)"}).select(F.col("id").alias("top"), F.col("path").alias("above"))
    ends = short.join(whole.hint("merge"), "top", "left").select("id", F.concat(F.lit("/"), F.coalesce("above", F.lit("")), "path").alias("path"))
    return nodes.join(ends.hint("merge"), "id").select(*nodes.columns, "path")


def intervals(nodes: DataFrame) -> DataFrame:
    """(id, outcome, depth, enter, leave) of nodes (id, parent_id): places at which a walk through the trees, children by id, enters and leaves each node; null unless outcome is ok.

    b lies below a, or is a, where a.enter <= b.enter <= a.leave; there are (leave - enter + 1) / 2 such
    nodes. The walk is a list: from entering a node to entering its first child, or to leaving it; from
    leaving it to entering its next sibling, or to leaving its parent. Places are ranks in this list, by
    pointer doubling, so a chain of any length takes as many rounds as the logarithm of its length.
    """
    shared_dir(nodes.sparkSession)
    own = nodes.select("id", "parent_id").join(depths(nodes).hint("merge"), "id").checkpoint()
    good = own.where("outcome = 'ok'").select("id", "parent_id")
    # Roots are the children of nothing; siblings follow each other in the order of (parent, id).
    ordered = ordering.with_next(good, [F.col("parent_id").asc_nulls_first(), F.col("id")], ["parent_id", "id"])
    sibling = F.when(F.col("next").isNotNull() & F.col("next.parent_id").eqNullSafe(F.col("parent_id")), F.col("next.id"))
    first = good.where("parent_id is not null").groupBy("parent_id").agg(F.min("id").alias("child")).withColumnRenamed("parent_id", "id")
    known = ordered.select("id", "parent_id", sibling.alias("sibling")).join(first.hint("merge"), "id", "left")
    enters = known.select((F.col("id") * 2).alias("id"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("up"))
    leaves = known.select((F.col("id") * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent_id") * 2 + 1).alias("up"))
    steps = enters.unionByName(leaves).select("id", "up", F.lit(None).cast("string").alias("stop"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("left"))
    ranks = _doubled(steps, {"left": "a.left + b.left"})
    last = ranks.agg(F.max("left").alias("last"))  # one row
    place = ranks.join(F.broadcast(last), how="cross").select(F.shiftright("id", 1).alias("id"), (F.col("id").bitwiseAND(1) == 0).alias("in"), (F.col("last") - F.col("left")).alias("at"))
    both = place.groupBy("id").agg(F.max(F.when(F.col("in"), F.col("at"))).alias("enter"), F.max(F.when(~F.col("in"), F.col("at"))).alias("leave"))
    return own.join(both.hint("merge"), "id", "left").select("id", "outcome", "depth", "enter", "leave")


def below(places: DataFrame, asked: DataFrame, width: int = 1024) -> DataFrame:
    """(id, above): each node of places (intervals) with the asked ones that it lies below, or is; asked holds rows of places. Places are cut into bins: a node lies in one, an asked one's interval in those that it reaches, so they meet by equal bin."""
    near = places.select("id", "enter", F.floor(F.col("enter") / width).alias("bin"))
    bins = F.explode(F.sequence(F.floor(F.col("enter") / width), F.floor(F.col("leave") / width)))
    wide = asked.select(F.col("id").alias("above"), F.col("enter").alias("from"), F.col("leave").alias("to"), bins.alias("bin"))
    return near.join(wide.hint("merge"), "bin").where("enter between `from` and `to`").select("id", "above")
