"""Conversations rendered for training, without the snapshots that longer ones contain: op2. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatehouse.llm import common

#: What stands around each turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation that are put in order together.
STRETCH = 1024


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with their place in the conversation (from 1) and two rolling hashes of the turns up to there.

    The rolling hash is the exclusive or of hashes of (place, role, text), so stretches of turns are
    summed up first, map-side, and a window runs over each stretch and over the stretches: a very long
    conversation isn't ordered in one task.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null")
    own = own.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(0)) / STRETCH)).withColumn("h", F.xxhash64("role", "text"))
    counts = own.groupBy("conv_id", "stretch").agg(F.count("*").alias("c"))
    along = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "stretch", F.coalesce(F.sum("c").over(along), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "h", F.col("role").asc_nulls_first())
    placed = own.withColumn("place", F.row_number().over(within)).join(before, ["conv_id", "stretch"]).withColumn("place", F.col("place") + F.col("before"))
    tagged = placed.withColumn("t1", F.xxhash64("place", "h", F.coalesce("role", F.lit("\0")))).withColumn("t2", F.xxhash64(F.lit(31), "place", "role", "text"))
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = tagged.withColumn("r1", F.bit_xor("t1").over(upto)).withColumn("r2", F.bit_xor("t2").over(upto))
    whole = tagged.groupBy("conv_id", "stretch").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    earlier = whole.select("conv_id", "stretch", *[F.coalesce(F.bit_xor(s).over(along), F.lit(0)).alias(f"e{s[1]}") for s in ("s1", "s2")])
    joined = rolled.join(earlier, ["conv_id", "stretch"])
    return joined.select("conv_id", "turn", "role", "text", "place", F.col("r1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("e2")).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """The placed turns of the conversations that prefix no other.

    A conversation's hash at its last turn is looked for among the hashes inside longer conversations
    (anti-join); of equal conversations the smallest conv_id stays.
    """
    placed = common.checkpoint(prefixes(turns))
    # The last place by a plain maximum; its hashes come by a join on it.
    length = placed.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    ends = placed.join(length, "conv_id").select("conv_id", "place", "n_turns", "p1", "p2")
    last, inside = ends.where("place = n_turns"), ends.where("place < n_turns")
    first = last.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    longer = inside.select(F.col("place").alias("n_turns"), "p1", "p2").distinct()
    kept = first.join(longer, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns")
    return placed.join(kept, "conv_id").select("conv_id", "n_turns", "place", "role", "text")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): every maximal conversation as one text, each turn between its marks.

    Turns are ordered by turn number, then by a hash of role and text, so repeated numbers have a fixed
    order. A null role is "user", a null text is empty. Rows without a conv_id take no part; a null turn
    number comes first. An empty table gives no rows. Other columns are ignored. The marks' own strings
    inside a text are split by a space, so that a text can't open or close a turn.
    """
    safe = F.coalesce("text", F.lit(""))
    for mark in (OPEN, CLOSE):
        safe = F.replace(safe, F.lit(mark), F.lit(mark[:2] + " " + mark[2:]))
    shown = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("user")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))
    one = maximal(turns).groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))).alias("x"))
    return one.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join("x.shown", "").alias("rendered"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation rendered."""
    return render(common.table(spark, sf_dir, "conversations"))


OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         md5(concat(coalesce(role, chr(1)), chr(2), coalesce(text, chr(1)))) AS h
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, place, n_turns,
         md5(string_agg(h, ',' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS prefix
  FROM t),
f AS (SELECT prefix, n_turns, min(conv_id) AS conv_id FROM p WHERE place = n_turns GROUP BY prefix, n_turns),
k AS (SELECT conv_id FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n_turns AND p.place = f.n_turns AND p.prefix = f.prefix))
SELECT conv_id, max(n_turns)::BIGINT AS n_turns,
       string_agg(concat('{OPEN}', coalesce(role, 'user'), chr(10),
         replace(replace(coalesce(text, ''), '{OPEN}', '{OPEN[:2]} {OPEN[2:]}'), '{CLOSE}', '{CLOSE[:2]} {CLOSE[2:]}'),
         '{CLOSE}', chr(10)), '' ORDER BY place) AS rendered
FROM t SEMI JOIN k USING (conv_id) GROUP BY conv_id
"""
