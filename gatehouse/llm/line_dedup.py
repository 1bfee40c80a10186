"""Lines that repeat across documents, up to a few edits, by a segment-partition edit join: op4 and a stage of the pipeline. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

#: Edits (insertions, deletions, substitutions of a code point) within which two lines are copies, where the caller names no other number.
EDITS = 1
#: Lines with fewer code points than this always stay, where the caller names no other length.
MIN_CHARS = 16
#: Lines in a bucket from which its pairs aren't compared but its lines are cut into finer windows.
CROWD = 32
#: By the number of edits, the parts into which each window of a crowded bucket is cut.
FINER = {1: 16, 2: 4, 3: 2}


def _seats(edits: int) -> list[tuple[int, int, int]]:
    """(i, s, more): a line that is `more` longer than an indexed one may hold the indexed line's segment i s code points further on.

    Of edits + 1 segments there is one without an edit, with at most i edits in the i segments before it
    and at most edits - i in those after it, so no other shift has to be probed.
    """
    return [(i, s, more) for more in range(edits + 1) for i in range(edits + 1) for s in range(-i, i + 1) if abs(more - s) <= edits - i]


def _bounds(n: Column, edits: int) -> list[Column]:
    """Where the edits + 1 segments of a line of n code points begin, and its end."""
    return [F.floor(n * i / (edits + 1)) for i in range(edits + 1)] + [n]


def _growths(edits: int) -> list[tuple[int, ...]]:
    """By how much each of `edits` windows may be longer in the probing line, which is at least as long as the indexed one."""
    return [d for d in product(range(-edits, edits + 1), repeat=edits) if sum(map(abs, d)) <= edits and sum(d) >= 0]


def _cuts(spark: SparkSession, edits: int, first: bool) -> DataFrame:
    """How posts of a crowded bucket are cut: (state, to, g0, j0, d0, ...), one row a choice of `edits` parts, part j of window g, and of their growths d.

    Growths within a window add up to the window's own, or in the first round, where only the shift of
    the shared segment is told, to those before and after it. As many rows as the number of edits makes.
    """
    growths, rows = _growths(edits), []
    sums = [({g: int(g >= i) for g in range(edits)}, (s, more - s)) for i, s, more in _seats(edits)] if first else [({g: g for g in range(edits)}, d) for d in growths]
    parts = list(combinations(product(range(edits), range(FINER[edits])), edits))
    for state, (zone, wanted) in enumerate(sums):
        for chosen in parts:
            for to, d in enumerate(growths):
                found = [0] * len(wanted)
                for (g, _), x in zip(chosen, d, strict=True):
                    found[zone[g]] += x
                if tuple(found) == wanted:
                    rows.append((state, to, *[v for (g, j), x in zip(chosen, d, strict=True) for v in (g, j, x)]))
    return spark.createDataFrame(rows, "state int, to int, " + ", ".join(f"g{w} int, j{w} int, d{w} int" for w in range(edits)))


def _outside(edits: int) -> list[Column]:
    """What a line holds outside the windows of its post, piece by piece, each where the growths before it put it."""
    line, at, s, pieces = F.col("line"), F.lit(0).cast("long"), F.lit(0), []
    for w in range(edits):
        pieces.append(F.substring(line, (at + s + 1).cast("int"), (F.col(f"b{w}") - at).cast("int")))
        at, s = F.col(f"e{w}"), s + F.col(f"d{w}")
    return [*pieces, F.substring(line, (at + s + 1).cast("int"), (F.col("n") - at).cast("int"))]


def _inside(edits: int) -> list[Column]:
    """What a line holds in each window of its post."""
    s, held = F.lit(0), []
    for w in range(edits):
        held.append(F.substring("line", (F.col(f"b{w}") + s + 1).cast("int"), (F.col(f"e{w}") - F.col(f"b{w}") + F.col(f"d{w}")).cast("int")))
        s = s + F.col(f"d{w}")
    return held


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, mark, at, line, n, h1, h2) of the lines that are long enough; mark tells rows of one doc_id apart."""
    split = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = split.withColumn("n", F.length("line").cast("long")).where(F.col("n") >= min_chars)
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def _place() -> Column:
    """A line's place in the order of documents and their lines, as one number; null ids come first."""
    return (F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("decimal(19,0)").cast("decimal(30,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + F.col("at").cast("decimal(10,0)")).cast("decimal(38,0)")


def _distinct(lines: DataFrame, edits: int) -> DataFrame:
    """One row a distinct line: its hashes, how often it occurs, its first place, and its keys with edits + 1 segments.

    An indexed line of n code points has a key for each of its segments; a line that is up to `edits`
    longer, or as long, probes the index of length n where that segment may stand in it.
    """
    keys = {}
    for k, (i, s, more) in enumerate(_seats(edits)):
        n = F.col("n") - more
        at = _bounds(n, edits)
        keys[f"k{k}"] = F.xxhash64(F.lit(i), n, F.substring(F.col("line"), (at[i] + s + 1).cast("int"), (at[i + 1] - at[i]).cast("int")))
    keyed = lines.select("h1", "h2", "n", _place().alias("place"), *[v.alias(k) for k, v in keys.items()])
    return keyed.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("place").alias("place"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in keys])


def _posted(distinct: DataFrame, edits: int) -> DataFrame:
    """The keys as rows: (h1, n, probe, state, b0, e0, ..., key), n being the length of the index that the key belongs to, the windows its other segments."""
    posts = []
    for k, (i, s, more) in enumerate(_seats(edits)):
        n = F.col("n") - more
        at = _bounds(n, edits)
        windows = [x.cast("long").alias(f"{name}{w}") for w, g in enumerate(g for g in range(edits + 1) if g != i) for name, x in (("b", at[g]), ("e", at[g + 1]))]
        posts.append(F.struct(n.alias("n"), F.lit((s, more) != (0, 0)).alias("probe"), F.lit(k).alias("state"), *windows, F.col(f"k{k}").alias("key")))
    return distinct.select("h1", F.explode(F.array(*posts)).alias("x")).select("h1", "x.*")


def _useful(posts: DataFrame) -> DataFrame:
    """Posts whose bucket can hold a link, with the bucket's size: two indexed lines, or one and a probe."""
    sizes = posts.groupBy("key").agg(F.count("*").alias("size"), F.count_if(~F.col("probe")).alias("indexed")).where("indexed > 0 and size > 1").select("key", "size")
    return posts.join(sizes, "key")


def _pairs(posts: DataFrame, crowd: int) -> DataFrame:
    """Distinct pairs of lines in buckets that aren't crowded."""
    few = posts.where(F.col("size") <= crowd)
    x, y = few.where("not probe").alias("x"), few.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("y.probe") | (F.col("x.h1") < F.col("y.h1"))) & (F.col("x.h1") != F.col("y.h1")))
    return met.select(F.least("x.h1", "y.h1").alias("a"), F.greatest("x.h1", "y.h1").alias("b")).distinct()


def _finer(crowded: DataFrame, texts: DataFrame, edits: int, first: bool) -> DataFrame:
    """Posts of crowded buckets again, with narrower windows: `edits` of the parts into which the bucket's windows are cut, since no more parts than that hold an edit."""
    cut = crowded.drop(*[f"d{w}" for w in range(edits)]).join(F.broadcast(_cuts(crowded.sparkSession, edits, first)), "state")
    low, high = F.array(*[f"b{w}" for w in range(edits)]), F.array(*[f"e{w}" for w in range(edits)])
    windows = []
    for w in range(edits):
        b = F.element_at(low, F.col(f"g{w}") + 1)
        width = F.element_at(high, F.col(f"g{w}") + 1) - b
        windows += [(b + F.floor(F.col(f"j{w}") * width / FINER[edits])).alias(f"b{w}"), (b + F.floor((F.col(f"j{w}") + 1) * width / FINER[edits])).alias(f"e{w}"), f"d{w}"]
    cut = cut.select("h1", "n", F.exists(F.array(*[f"d{w}" for w in range(edits)]), lambda d: d != 0).alias("probe"), F.col("to").alias("state"), *windows)
    for w in range(edits):
        cut = cut.where((F.col(f"e{w}") > F.col(f"b{w}")) & (F.col(f"e{w}") - F.col(f"b{w}") + F.col(f"d{w}") >= 0))
    ends = [f"{x}{w}" for w in range(edits) for x in "be"]
    return cut.distinct().join(texts, "h1").select(*cut.columns, F.xxhash64("n", *ends, *_outside(edits)).alias("key"))


def _narrow(posts: DataFrame, texts: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """Groups and pairs of crowded buckets whose windows are one code point each; no pair of indexed lines is compared there.

    Indexed lines that are alike outside the windows, which is looked up in the texts, differ there
    alone, so all of them are within the edits of each other: one group (g, h1). A probe is longer in a
    window, so it links only with indexed lines that have one of its code points in the same window:
    pairs (a, b) still to be verified.
    """
    held = posts.join(texts, "h1").select("h1", "key", "probe", F.concat(*_outside(edits)).alias("rest"), F.array(*_inside(edits)).alias("own"))
    indexed = held.where("not probe")
    first = indexed.groupBy("key").agg(F.min_by("rest", "h1").alias("first"))
    groups = indexed.join(first, "key").where("rest = first").select(F.col("key").alias("g"), "h1")
    points = F.array_distinct(F.flatten(F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.substring(F.get("own", F.lit(w)), t, 1).alias("point")) for t in range(1, edits + 2)]) for w in range(edits)])))
    asked = held.where("probe").select("key", F.col("h1").alias("a"), F.explode(points).alias("x")).where("x.point != ''")
    there = indexed.select("key", F.col("h1").alias("b"), F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.get("own", F.lit(w)).alias("point")) for w in range(edits)])).alias("x"))
    return groups, asked.join(there, ["key", "x"]).where("a != b").select("a", "b")


def line_links(lines: DataFrame, distinct: DataFrame, crowd: int = CROWD, edits: int = EDITS) -> DataFrame:
    """Groups (g, h1) of the hashes of different lines: all lines of a group are within `edits` of each other, and any two lines within `edits` share a group.

    Buckets of up to `crowd` lines are compared pair by pair with the banded edit distance; a pair is a
    group of two. A larger bucket's lines are alike outside its windows, so they are keyed again by
    narrower windows within them, and so on, until the buckets are small or each window is one code
    point; so a bucket costs some rows a line, more with more edits, and no square of its size.
    """
    posts = common.checkpoint(_useful(_posted(distinct, edits)))
    wanted = common.checkpoint(posts.select("h1").distinct())
    own = lines.select("h1", "line").join(F.broadcast(wanted) if wanted.count() <= common.BROADCAST_IDS else wanted, "h1")
    texts = common.written(own.dropDuplicates(["h1"]), "line-texts")
    pairs, groups = [], []
    first, wide = True, F.greatest(*[F.col(f"e{w}") - F.col(f"b{w}") for w in range(edits)], F.lit(0)) > 1
    while True:
        pairs.append(_pairs(posts, crowd))
        crowded = posts.where(F.col("size") > crowd)
        if not first:
            alike, either = _narrow(crowded.where(~wide), texts, edits)
            groups.append(alike)
            pairs.append(either.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
            crowded = crowded.where(wide)
        if crowded.isEmpty():
            break
        posts, first = common.checkpoint(_useful(_finer(crowded, texts, edits, first))), False
    met = reduce(DataFrame.unionByName, pairs).distinct()
    x, y = texts.select(F.col("h1").alias("a"), F.col("line").alias("x")), texts.select(F.col("h1").alias("b"), F.col("line").alias("y"))
    near = met.join(x, "a").join(y, "b").where(F.levenshtein("x", "y", edits) >= 0)
    two = near.select(F.xxhash64(F.lit(11), "a", "b").alias("g"), F.explode(F.array("a", "b")).alias("h1"))
    return reduce(DataFrame.unionByName, groups, two)


def dropped(groups: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1) of the lines that go: each shares a group with a line that stays, and no two that stay share one.

    The commonest line goes first, ties by hash. In each round the lines that come first in all their
    groups stay, the others of those groups go, and both leave the groups; by the hash a chain of lines
    falls into short pieces, so rounds are few, and each is a few joins over what is left.
    """
    ranked = groups.join(distinct.select("h1", F.struct((-F.col("c")).alias("c"), "h1").alias("rank")), "h1")
    left = common.checkpoint(ranked.select("g", "h1", "rank").distinct())
    gone = []
    while not left.isEmpty():
        first = left.groupBy("g").agg(F.min("rank").alias("first"))
        told = left.join(first, "g").withColumn("leads", F.col("rank") == F.col("first"))
        stay = common.checkpoint(told.groupBy("h1").agg(F.bool_and("leads").alias("stays")).where("stays").select("h1"))
        hit = left.join(stay, "h1", "left_semi").select("g").distinct()
        out = common.checkpoint(left.join(hit, "g", "left_semi").select("h1").distinct().join(stay, "h1", "left_anti"))
        gone.append(out)
        left = common.checkpoint(left.join(out.unionByName(stay), "h1", "left_anti"))
    return reduce(DataFrame.unionByName, gone) if gone else groups.select("h1").limit(0)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, crowd: int = CROWD, edits: int = EDITS) -> DataFrame:
    """docs with their text's repeated lines left out, and n_lines and n_dropped.

    Lines (between newlines) of min_chars code points or more, at least edits + 1, are looked at; shorter ones stay. Of equal
    lines the occurrence with the smallest doc_id, and in it the first, stays, all others go, in the same
    document too. A line goes altogether if it is within `edits` edits of a code point (1 to 3) of a line that stays;
    of two such lines the commoner stays, of equally common ones the one with the smaller hash (dropped).
    Lines that are connected through others only stay. What stays is joined by newlines in order;
    n_chars, where docs has it, follows the new text.

    Lines are first counted by two 64-bit hashes, map-side, so copies of a line are one row from then on;
    edits are searched among distinct lines (line_links), which one of the hashes names. Only the texts
    of lines in shared buckets travel, and each document once, to meet the places of its dropped lines.

    Null text stays null and has no line; empty text has one line and stays. Of rows that share a
    doc_id each counts as a document of its own, and a line at one place in several of them stays in
    each. Null doc_ids come first. An empty table gives no rows. Other columns are kept, whatever their
    names; n_lines and n_dropped replace columns of the same names.
    """
    if edits not in FINER:
        raise ValueError(f"edits must be one of {sorted(FINER)}")
    docs = docs.drop("n_lines", "n_dropped")
    lines = _lines(docs, max(min_chars, edits + 1))
    distinct = common.checkpoint(_distinct(lines, edits))
    near = dropped(line_links(lines, distinct, crowd, edits), distinct).withColumn("all", F.lit(True))
    often = distinct.where("c > 1")
    copies = often.join(near, "h1", "left_anti").select("h1", "h2", F.col("place").alias("keep")).unionByName(distinct.join(near, "h1").select("h1", "h2", F.lit(None).cast("decimal(38,0)").alias("keep")))
    copies = common.checkpoint(copies)
    occurring = lines.select("doc_id", "mark", "at", "h1", "h2")
    met = occurring.join(F.broadcast(copies) if copies.count() <= common.BROADCAST_IDS // 2 else copies, ["h1", "h2"])
    gone = met.where(F.col("keep").isNull() | (_place() != F.col("keep"))).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    split = F.split("row.text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")), lambda i: F.element_at(split, i + 1))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    new = joined.withColumn("text", text)
    values = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    columns = [values.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    counts = [F.when(F.col("row.text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return new.select(*columns, *counts)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines counted, those dropped, and the size and checksum of what stays."""
    kept = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    return kept.select("doc_id", "n_lines", "n_dropped", "n_chars", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
