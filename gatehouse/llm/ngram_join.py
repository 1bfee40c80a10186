"""Near-duplicate documents by a Jaccard join on word shingles with token-combination prefixes: op1 and a stage of the pipeline."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatehouse.llm import common

#: Counters of the shingle frequencies (a power of two of them) and how many travel in a row.
SKETCH_BITS, SKETCH_ROW = 23, 1 << 16
#: Steps of a doubling in which frequencies are told apart.
STEPS = 8
#: Share of the used counters below which a shingle is rare; of the others, the frequent ones, only combinations of two are indexed.
RARE = 0.999
#: Bits of the parity sketch of a shingle set, 64 a word, at least; larger sets have as many bits as shingles or more, in powers of two.
PARITY = 512
#: Sizes within such a factor have one leader in a bucket.
BAND = 1.05
#: Documents whose keys are put together at a time.
TOGETHER = 1000
#: Zones of sizes in the span within which two sizes can link.
ZONES = 3


def _need(of: int, size: np.ndarray | int, per: int):
    """ceil(of * size / per) in integers."""
    return -((-of * size) // per)


def _packed(counts: np.ndarray) -> bytes:
    """Counters in one byte each where they fit, else in eight, compressed: most are small or zero."""
    return zlib.compress(counts.astype("<u1" if counts.max() < 256 else "<u8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, "<u1" if len(raw) <= SKETCH_ROW else "<u8").astype(np.uint64)


def _sketch(size: int, bits: int):
    row = min(SKETCH_ROW, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        for batch in batches:
            raw, start, end = common.texts_of(batch.column("text"))
            held, n = [], 0
            for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                held.append((common.shingles(raw[a:b], size) >> shift).astype(np.int64))
                n += len(held[-1])
                if n > 1 << 20 or k + 1 == len(start):
                    at, seen = np.unique(np.concatenate(held), return_counts=True)
                    counts[at] += seen.astype(np.uint32)
                    held, n = [], 0
            common.spare()
        for k in range(0, 1 << bits, row):
            part = counts[k : k + row]
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([k // row], pa.int32()), "counts": pa.array([_packed(part)], pa.binary())})

    return count


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = _unpacked(counts)
            sums[part] = sums[part] + own if part in sums else own
    if sums:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([_packed(x) for x in sums.values()], pa.binary())})


def levels(counts: np.ndarray) -> np.ndarray:
    """Frequencies on a logarithmic scale of a byte: none is 0, one is 1, and STEPS more are a doubling."""
    return np.where(counts > 0, np.minimum(255, 1 + np.log2(np.maximum(counts, 1).astype(np.float64)) * STEPS + 1e-9), 0).astype(np.uint8)


def frequencies(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """The levels of counters of all shingles of all documents by hash: 2 ** bits of them, whatever the corpus.

    Each task counts into one array and sends it on in rows, which are added up as they come. The
    counters only order the shingles and tell frequent ones; no link depends on their exactness.
    """
    parts = docs.select("text").mapInArrow(_sketch(size, bits), "part int, counts binary")
    sums = parts.repartition("part").mapInArrow(_sum_parts, "part int, counts binary")
    row = min(SKETCH_ROW, 1 << bits)
    out = np.zeros(1 << bits, np.uint8)
    for r in sums.collect():  # as many bytes as counters, at most eight times
        out[r["part"] * row : (r["part"] + 1) * row] = levels(_unpacked(r["counts"]))
    return out


def frequent_from(often: np.ndarray, rare: float = RARE) -> int:
    """The level from which a shingle is frequent: a quantile of the counters in use, so that it goes with the size of the corpus, and that of two at least."""
    used = often[often > 0]
    return max(1 + STEPS, int(np.quantile(used, rare))) if len(used) else 1 + STEPS


def prefix_keys(tokens: np.ndarray, often: np.ndarray, percent: int, frequent: int) -> np.ndarray:
    """Index keys for a document's shingles in global order (rare first).

    Two documents that link share at least one token among the first P = n - ceil(t n) + 1 of each,
    and at least s among the first P + s - 1. Where the first P tokens are all rare, each is a key.
    Otherwise rare ones are keys, and frequent ones are dealt into m classes by hash: with s = m + 1
    shared tokens, one is rare or two frequent ones are of one class, so the pairs within classes
    are the keys. m goes by the power of two below P, about eight tokens a class; a document uses
    every m from that of the smallest document it can link with to its own, so two that link have one
    in common, the smaller one's.
    """
    n = len(tokens)
    first = n - _need(percent, n, 100) + 1
    prefix = tokens[:first]
    if often[first - 1] < frequent:
        return prefix
    least = _need(percent, n, 100)
    keys = [tokens[:first][often[:first] < frequent]]
    low, high = _classes(least - _need(percent, least, 100) + 1), _classes(first)
    for classes in [1 << k for k in range(min(low, high).bit_length() - 1, max(low, high).bit_length())]:
        extended = tokens[: first + classes]
        hot = extended[often[: first + classes] >= frequent]
        own = (hot % np.uint64(classes)).astype(np.int64)
        for k in range(classes):
            some = np.sort(hot[own == k])
            a, b = np.triu_indices(len(some), 1)
            keys.append(common.mix(some[a] * np.uint64(3) + common.mix(some[b] + np.uint64(classes))))
    return np.unique(np.concatenate(keys))


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bits, each set if an odd number of tokens fall on it: two sets differ in at least as many tokens as their sketches in bits. A sketch's halves put together by exclusive or are the sketch of half as many bits."""
    bits = max(PARITY, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else PARITY
    odd = np.bincount((common.mix(tokens + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _classes(first: int) -> int:
    return max(1, 1 << max(0, int(first).bit_length() - 4))


def _indexer(size: int, percent: int, frequent: int, counts):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        shift = np.uint64(65 - len(table).bit_length())
        for batch in (whole.slice(k, TOGETHER) for whole in batches for k in range(0, whole.num_rows, TOGETHER)):
            raw, start, end = common.texts_of(batch.column("text"))
            rows: list[list] = [[] for _ in range(5)]
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                tokens = common.shingles(raw[a:b], size)
                n = len(tokens)
                ones = tokens.sum(dtype=np.uint64), (common.mix(tokens) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                keys = np.zeros(0, np.uint64)
                if n:
                    often = table[(tokens >> shift).astype(np.int64)]
                    order = np.lexsort((tokens.view(np.int64), often))
                    keys = prefix_keys(tokens[order], often[order], percent, frequent)
                for column, x in zip(rows, (n, np.array(ones[0]).view(np.int64).item(), np.array(ones[1]).view(np.int64).item(), keys.view(np.int64), parity(tokens)), strict=True):
                    column.append(x)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())) for x in rows[3:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in rows[:3]], *lists], ["doc_id", "n", "d1", "d2", "keys", "sketch"])
        common.spare()

    return index


def _verifier(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)  # the left text, whose pairs follow each other, and its shingles
        for batch in batches:
            ids = [batch.column(k).to_pylist() for k in ("a", "b")]
            (left, l0, l1), (right, r0, r1) = (common.texts_of(batch.column(k)) for k in ("text_a", "text_b"))
            keep = []
            for k in range(batch.num_rows):
                text = left[l0[k] : l1[k]].tobytes()
                if held[0] != text:
                    held = text, common.shingles(left[l0[k] : l1[k]], size)
                x, y = held[1], common.shingles(right[r0[k] : r1[k]], size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_pydict({"a": pa.array([ids[0][k] for k in keep], pa.int64()), "b": pa.array([ids[1][k] for k in keep], pa.int64())})
            common.spare()

    return verify


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose texts link, checkpointed. Only the texts of documents in pairs travel, and the joins are plain ones that can be split where a key is hot."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts, texts_at = common.placed(common.keep_ids(docs, wanted, "left_semi"), "ngram-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    near = common.checkpoint(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verifier(size, percent), "a long, b long"))
    common.cleared(docs.sparkSession, texts_at)
    return near


def _band(n: Column, factor: float) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(factor)))).cast("int")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes and parity sketches of two rows leave a link possible: a set of n shingles and one of m differ, where they link, in (n + m) * (100 - percent) / (100 + percent) shingles at most. Of two sketches the longer one is folded to the shorter one's length."""
    n, m, a, b = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.sketch"), F.col(f"{y}.sketch")
    words = PARITY // 64
    short = reduce(Column.__add__, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(words)])
    half = F.least(F.size(a), F.size(b))
    folded = lambda c: F.when(F.size(c) == half, c).otherwise(F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda i, j: i.bitwiseXOR(j)))
    long = F.aggregate(F.zip_with(folded(a), folded(b), lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, i: s + i)
    apart = F.when((F.size(a) == words) & (F.size(b) == words), short).otherwise(long)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, frequent: int | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose sets of `size`-word shingles have a Jaccard likeness of percent / 100 or more are linked.

    1. Counters give every shingle a frequency, rare ones come first (frequencies); frequent ones are
       those in `frequent` documents or more, where it isn't given from a quantile of the counters on.
    2. Documents with equal sets become one representative, the smallest doc_id.
    3. Representatives meet in the buckets of their prefix keys (prefix_keys), as far as a bucket has
       another one of a size that can link. Each is compared with
       one leader: of the leaders of its buckets and size bands (the member with most shared
       buckets), the one it meets most often; leaders of neighbouring bands are compared as well.
       Links are contracted to components, so a large group of near copies costs a pair a member.
    4. In buckets that still hold several components, pairs of different components are compared,
       each once. No pair that could join two components is left out,
       so components are exact.

    Texts are compared only for pairs whose sizes and parity sketches leave a link possible: a bit or
    more a shingle, in which two sets differ at most as often as in their shingles. Only texts of such
    pairs travel. Scratch tables are cleared as soon as nothing reads them.

    Texts without words have no shingles and link with nothing, their component is their own id.
    Rows of one doc_id count as one document that has each text; each row comes back, all with one
    component. Null doc_ids link with nothing and have a null component. An empty table gives no
    rows. Other columns are ignored. percent is 51 to 100: below that, two sets may link by a single common shingle, and combinations would miss them.
    """
    if not 51 <= percent <= 100:
        raise ValueError("percent must be 51 to 100")
    spark = docs.sparkSession
    common.small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = frequencies(plain, size, bits)
    frequent = frequent_from(counts) if frequent is None else int(levels(np.array([frequent]))[0])
    index = plain.mapInArrow(_indexer(size, percent, frequent, spark.sparkContext.broadcast(counts)), "doc_id long, n long, d1 long, d2 long, keys array<long>, sketch array<long>")
    indexed = common.written(index.withColumn("row", F.monotonically_increasing_id()), "ngram-index")
    named = indexed.where("doc_id is not null and n > 0")
    classes = common.checkpoint(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    first = named.join(classes, ["n", "d1", "d2"]).where("doc_id = rep").groupBy("rep", "n", "d1", "d2").agg(F.min("row").alias("row"))
    only = common.checkpoint(first.select("row"))
    reps = indexed.join(F.broadcast(only) if only.count() <= common.BROADCAST_IDS else only, "row", "left_semi").withColumnRenamed("doc_id", "rep")
    members = named.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    zone = (100 / percent * 1.001) ** (1 / ZONES)
    posted = reps.select("rep", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    # Only a shingle that another document of a size that can link has too brings documents together.
    posted = posted.withColumn("zone", _band(F.col("n"), zone))
    near_by = Window.partitionBy("key").orderBy("zone").rangeBetween(-ZONES - 1, ZONES + 1)
    shared = posted.groupBy("key", "zone").agg(F.count("*").alias("c")).withColumn("c", F.sum("c").over(near_by)).where("c > 1").select("key", "zone")
    posts, posts_at = common.placed(posted.join(shared, ["key", "zone"]), "ngram-posts")
    central = posts.groupBy("rep").agg(F.count("*").cast("int").alias("met"))
    ranked = posts.join(central, "rep").withColumn("band", _band(F.col("n"), BAND))
    leaders = ranked.groupBy("key", "band").agg(F.max(F.struct("met", (-F.col("rep")).alias("minus"), "n")).alias("x"))
    leaders = common.checkpoint(leaders.select("key", "band", (-F.col("x.minus")).alias("leader"), F.col("x.n").alias("m")))
    own = posts.withColumn("band", _band(F.col("n"), BAND)).join(leaders, ["key", "band"]).where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("met"))
    nearest = own.groupBy("rep").agg(F.max(F.struct("met", (-F.col("leader")).alias("minus"))).alias("x")).select(F.col("rep").alias("b"), (-F.col("x.minus")).alias("a"))
    step = Window.partitionBy("key").orderBy("band")
    chain = leaders.withColumn("a", F.lead("leader").over(step)).withColumn("upper", F.lead("m").over(step)).where("a is not null and a <> leader and 100 * m >= %d * upper" % percent)
    pairs = nearest.select("a", "b").unionByName(chain.select("a", F.col("leader").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    facts = reps.select("rep", "n", "sketch")
    x, y = facts.alias("x"), facts.alias("y")
    pairs = common.checkpoint(pairs.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep")).where(_may_link("x", "y", percent)).select("a", "b").distinct())
    near = _verified(pairs, plain, size, percent)

    so_far = common.components(near)
    grouped = posts.join(so_far.withColumnRenamed("id", "rep"), "rep", "left").select("key", "zone", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = grouped.groupBy("key", "zone").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    mixed = mixed.select("key", "zone", F.min("low").over(near_by).alias("low"), F.max("high").over(near_by).alias("high")).where("low < high").select("key", "zone")
    left, left_at = common.placed(grouped.join(mixed, ["key", "zone"]).join(facts, "rep"), "ngram-mixed")
    x, y = left.alias("x"), left.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & _may_link("x", "y", percent))
    met = common.checkpoint(met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())
    rest = _verified(met, plain, size, percent)
    common.cleared(spark, posts_at, left_at)

    links = members.unionByName(near).unionByName(rest)
    found = common.components(links).select(F.col("id").alias("doc_id"), "component")
    return indexed.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents on three-word shingles at 90 %."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=3, percent=90)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component (near_duplicates) only its document with the smallest id stays, and one row of those with a repeated id; null ids stay."""
    found = common.checkpoint(near_duplicates(docs, size, percent).where("doc_id is not null"))
    left = common.keep_ids(docs, found.where("component_id <> doc_id"), "left_anti")
    again = common.checkpoint(found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return common.keep_ids(left, again, "left_anti").unionByName(common.keep_ids(left, again, "left_semi").dropDuplicates(["doc_id"]))
