"""URL filters by rules, and by gradient-boosted trees on lexical features where no rule fits: op11."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

#: Verdict, host and path of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Distinct labelled urls of each class, by smallest hash, on which the trees are fitted at most.
SAMPLE = 4_000
#: Suffixes of each level fall into so many buckets, so their statistics have a fixed size; labels that a bucket without any is taken to have, half of them blocked.
SUFFIXES, PRIOR = 4_096, 10
#: Trees, their depth, the weight of each, and from which score a url is blocked.
TREES, DEPTH, STEP, BLOCKED = 12, 4, 0.4, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of the host, and the shorter one with the path's first folder.
LEVELS = ("tld", "domain", "host", "folder")
LEXICAL = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "fragment", "extension")
FEATURES = (*LEXICAL, *(f"{k}_{x}" for k in LEVELS for x in ("rate", "seen")))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url; both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda k: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. A rule fits its host and all hosts below it, where the path starts with the rule's; of rules of one length that with the longer host wins, then the one named first."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    told = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in order]
    return F.coalesce(*told) if told else F.lit(None).cast("struct<rule:string,verdict:string>")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The lexical features of a url by name; those of null are those of an empty one."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    rest = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: a - F.when((c != "") & (share(c) > 0), share(c) * F.log2(share(c))).otherwise(0.0))
    found = {
        "length": n,
        "host_length": F.length(host),
        "labels": F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digits": F.when(n > 0, (n - F.length(F.translate(url, "0123456789", ""))) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(rest == "", 0).otherwise(F.length(rest) - F.length(F.replace(rest, F.lit("&"), F.lit(""))) + 1),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "fragment": F.instr(url, "#") > 0,
        "extension": F.length(F.regexp_extract(path, r"\.([^./]*)$", 1)),
    }
    return {k: c.cast("double") for k, c in found.items()}


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    """The bucket of each level's suffix."""
    domain = F.substring_index(host, ".", -2)
    found = {"tld": F.substring_index(host, ".", -1), "domain": domain, "host": host, "folder": F.concat(domain, F.regexp_extract(path, r"^(/[^/]*)/", 1))}
    return {k: F.pmod(F.xxhash64(c), F.lit(SUFFIXES)).cast("int") for k, c in found.items()}


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(level, bucket, n, blocked): labelled urls and blocked ones among them by suffix, at most len(LEVELS) * SUFFIXES rows, whatever the corpus."""
    host, path = host_path(F.col("url"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), b.alias("bucket")) for k, b in _suffixes(host, path).items()]))
    counted = labelled.select(F.col("blocked").cast("long").alias("blocked"), each.alias("x")).groupBy("x.level", "x.bucket").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"))
    return common.checkpoint(counted)


def with_features(rows: DataFrame, statistics: DataFrame, own: Column | None = None) -> DataFrame:
    """rows (url, …) with features, a vector of FEATURES. own: a row's label (0 or 1) that isn't to count in its suffixes' statistics."""
    host, path = host_path(F.col("url"))
    own = F.lit(None).cast("long") if own is None else own.cast("long")
    kept = F.struct(*rows.columns).alias("kept")
    out = rows.select(kept, own.alias("own"), *[c.alias(k) for k, c in lexical(F.col("url"), host, path).items()], *[b.alias(f"{k}_at") for k, b in _suffixes(host, path).items()])
    for k in LEVELS:
        side = statistics.where(F.col("level") == k).select(F.col("bucket").alias(f"{k}_at"), F.col("n").alias(f"{k}_n"), F.col("blocked").alias(f"{k}_blocked"))
        out = out.join(F.broadcast(side), f"{k}_at", "left")
        n = F.coalesce(f"{k}_n", F.lit(0)) - F.when(F.col("own").isNotNull(), 1).otherwise(0)
        blocked = F.coalesce(f"{k}_blocked", F.lit(0)) - F.coalesce("own", F.lit(0))
        out = out.withColumns({f"{k}_rate": (blocked + PRIOR / 2) / (n + PRIOR), f"{k}_seen": F.log1p(n.cast("double"))})
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(out)
    return assembled.select("kept.*", "features")


@dataclass
class Model:
    """Trees and the suffix statistics that they look at; without trees (labels of one class only, or none) the one score."""

    statistics: DataFrame | None
    trees: GBTClassificationModel | None
    only: float = 0.0

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (url, …) with block_score, from 0 to 1."""
        if self.trees is None:
            return rows.withColumn("block_score", F.lit(self.only))
        held = rows.select("url", F.struct(*rows.columns).alias("row"))
        told = self.trees.transform(with_features(held, self.statistics))
        return told.select("row.*", vector_to_array("probability")[1].alias("block_score"))


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 3) -> Model:
    """A model of labelled urls (url, blocked).

    Suffix statistics count all of them. The trees learn from at most `sample` distinct urls of each
    class, those with the smallest hashes, each with statistics that leave its own label out. A url with
    labels of both kinds is one of each; a null url is one like an empty one; rows without a label don't count.
    """
    known = labelled.where("blocked is not null").select("url", F.col("blocked").cast("boolean").alias("blocked"))
    statistics = suffix_statistics(known)
    single = known.groupBy("url", "blocked").agg(F.count("*").alias("n"))
    sides = [single.where(F.col("blocked") == b).orderBy(F.xxhash64(F.lit(seed), "url"), "url").limit(sample).select("url", "blocked") for b in (False, True)]
    some, path = common.placed(reduce(DataFrame.unionByName, sides).coalesce(1), "url-sample")
    classes = {r["blocked"] for r in some.select("blocked").distinct().collect()}
    if len(classes) < 2:
        common.cleared(labelled.sparkSession, path)
        return Model(None, None, float(True in classes))
    rows = with_features(some, statistics, F.col("blocked")).select("features", F.col("blocked").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=seed, checkpointInterval=-1).fit(rows)
    common.cleared(labelled.sparkSession, path)
    return Model(statistics, trees)


def judge(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of pages (page_id, url).

    A url that a rule fits takes the longest one's verdict, any other that of trees trained from
    labelled urls (url, blocked); without a table of these, from those that rules decide. A null url, or
    one without ://, has an empty host and path, and goes to the trees as well. Where nothing is
    labelled all others are allowed; where all labels are the same, they are the verdict. Rows of one
    page_id or url are judged each, a null page_id stays; an empty table gives no rows. Other
    columns are ignored. rules is a short list: each is an expression that every url passes.
    """
    host, path = host_path(F.col("url"))
    told = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("told", ruled(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = told.where("told is not null").select("url", (F.col("told.verdict") == "block").alias("blocked"))
    scored = fit(labelled).scored(told)
    verdict = F.coalesce("told.verdict", F.when(F.col("block_score") >= BLOCKED, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("told.rule").alias("rule"), verdict.alias("verdict"), "block_score")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    return judge(common.table(spark, sf_dir, "pages"))
