"""URL filters: rules first, then gradient-boosted trees on lexical features.

Features: lengths of url, host and path, depth, dots and dashes of the host, share of digits, entropy of the letters,
number of parameters, scheme, fragment, and statistics of the host's suffix, of the path's first segment and of both
together: their share of all urls and the share of blocked ones among their labelled ones. They are hashed to a fixed
number of bins, so that the tables of statistics have a bound, and a url's statistics leave out the fold of urls that it
is in, so that no label speaks for itself. The trees learn from urls with a label, by default those that a rule decides;
one without a label may be of either kind and counts as one to allow at the weight UNSURE. Of either kind a hash of the
row and its place chooses a sample, bounded by about SAMPLE in all, weighted back to its number. All of it are DataFrame expressions and Spark ML.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule, and is judged by the trees like
any other; where nothing, or everything, is labelled to block, every url that no rule decides is allowed; an empty table gives an empty
result; rows that repeat get the same verdict; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep, lower_ascii, table

#: Verdict, host and path of each rule, in order.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bound of the sample that the trees are fitted to.
SAMPLE = 4_000
#: Of hashed suffixes and segments; of urls whose labels are left out of each other's statistics.
BINS, FOLDS = 256, 5
#: Weight of a url without a label, against one of a label.
UNSURE = 0.25
TREES, DEPTH = 12, 4
FEATURES = ("f_url_len", "f_host_len", "f_path_len", "f_depth", "f_dots", "f_dashes", "f_digits", "f_entropy", "f_params", "f_https", "f_fragment", "f_suffix_share", "f_suffix_block", "f_segment_share", "f_segment_block", "f_both_share", "f_both_block")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a letter."""
    n = F.length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c))) / n)
    return F.when(n > 0, F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(F.lit(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds host, path and the lexical features to a table with a url."""
    d = pages.withColumn("u", F.coalesce("url", F.lit(""))).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    number = {
        "f_url_len": F.length("u"),
        "f_host_len": F.length("host"),
        "f_path_len": F.length("path"),
        "f_depth": F.length("path") - F.length(F.replace("path", F.lit("/"))),
        "f_dots": F.length("host") - F.length(F.replace("host", F.lit("."))),
        "f_dashes": F.length("host") - F.length(F.replace("host", F.lit("-"))),
        "f_digits": F.length(F.regexp_replace("u", "[^0-9]+", "")) / F.greatest(F.length("u"), F.lit(1)),
        "f_entropy": entropy(F.col("u")),
        "f_params": F.when(F.instr("u", "?") > 0, F.length(F.regexp_replace("u", "[^&=]+", ""))).otherwise(F.lit(0)),
        "f_https": F.col("u").startswith("https").cast("int"),
        "f_fragment": (F.instr("u", "#") > 0).cast("int"),
    }
    d = d.withColumns({k: v.cast("double") for k, v in number.items()})
    suffix, segment = F.element_at(F.split("host", r"\."), -1), F.split_part("path", F.lit("/"), F.lit(2))
    bins = {k: F.pmod(F.xxhash64(v), F.lit(BINS)).cast("int") for k, v in (("suffix_bin", suffix), ("segment_bin", segment), ("both_bin", F.concat_ws("/", suffix, segment)))}
    return d.withColumns(bins).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "u"), F.lit(FOLDS)).cast("int")).drop("u")


def statistics(featured: DataFrame, what: str) -> DataFrame:
    """Of each bin of ``what`` and each fold: the bin's share of urls, and of blocked ones among its labelled ones, in the other folds; at most BINS x FOLDS rows."""
    t = featured.groupBy(F.col(f"{what}_bin").alias("of_bin"), F.col("fold").alias("of_fold")).agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked"))
    # Folds in which a bin has no url meet no row; those that have some leave their own out.
    whole, own, fold = (W.partitionBy(*x) for x in ([F.lit(0)], ["of_bin"], ["of_fold"]))
    n = F.sum("n").over(own) - F.col("n")
    share = n / F.greatest(F.sum("n").over(whole) - F.sum("n").over(fold), F.lit(1))
    blocked = (F.sum("blocked").over(own) - F.col("blocked") + 0.5) / (F.sum("known").over(own) - F.col("known") + 1.0)
    return t.select("of_bin", "of_fold", share.alias(f"f_{what}_share"), blocked.alias(f"f_{what}_block"))


def with_statistics(featured: DataFrame) -> DataFrame:
    for what in ("suffix", "segment", "both"):
        own = statistics(featured, what)
        featured = featured.join(F.broadcast(own), (featured[f"{what}_bin"] == own["of_bin"]) & (featured["fold"] == own["of_fold"])).drop("of_bin", "of_fold")
    return featured


def fit(featured: DataFrame, sample: int = SAMPLE) -> PipelineModel | None:
    """Trees on rows with the features and a label, 1 to block, 0 to allow or null; None where one kind doesn't occur."""
    d = featured.withColumn("sure", F.when(F.col("label").isNull(), UNSURE).otherwise(1.0)).withColumn("label", F.coalesce("label", F.lit(0.0)))
    kinds = {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return None
    share = F.when(F.col("label") > 0, min(1.0, sample / 2 / kinds[1.0])).otherwise(min(1.0, sample / 2 / kinds[0.0]))
    draw = F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    # All tasks filter; only the sample, which has a bound, goes to one partition, and is written so that it's drawn once.
    # In one sorted partition floating-point sums, and so the trees, come out alike in each run.
    chosen = d.withColumn("draw", draw).filter(F.col("draw") < share).select("label", (F.col("sure") / share).alias("weight"), *FEATURES)
    chosen = keep(chosen.repartition(1).sortWithinPartitions(*FEATURES, "label"), "url-sample")
    if chosen.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1)
    return PipelineModel([rows, trees.fit(rows.transform(chosen))])


def labelled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: Column | None = None) -> DataFrame:
    """(page_id, url) rows with features, statistics, rule, decided (its verdict) and label: 1 to block, 0 to allow, or null."""
    d = lexical(pages.select("page_id", "url"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", rule).withColumn("decided", decided)
    own = F.when(F.col("decided") == "block", 1.0).when(F.col("decided") == "allow", 0.0) if labels is None else labels
    return with_statistics(d.withColumn("label", own.cast("double")))


def judged(featured: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds block_probability and own, the trees' verdict."""
    if model is None:
        d = featured.withColumn("block_probability", F.lit(0.0))
    else:
        d = model.transform(featured).withColumn("block_probability", F.get(vector_to_array("probability"), F.lit(1)))
    return d.withColumn("own", F.when(F.col("block_probability") > 0.5, "block").otherwise("allow"))


def held_out_quality(pages: DataFrame) -> dict[str, float]:
    """Precision and recall of the trees' verdict to block on a fold of urls whose labels they haven't seen, as the rules have it."""
    d = labelled(pages)
    hidden = F.col("fold") == 0
    got = judged(d.filter(hidden & F.col("label").isNotNull()), fit(d.filter(~hidden)))
    hit, said, true = got.agg(F.count_if((F.col("own") == "block") & (F.col("label") == 1)), F.count_if(F.col("own") == "block"), F.count_if(F.col("label") == 1)).first()
    return {"precision": hit / max(said, 1), "recall": hit / max(true, 1), "blocked": float(true)}


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: Column | None = None) -> DataFrame:
    """(page_id, url) rows with host, path, rule, block_probability and verdict. ``labels``: 1 to block, 0 to allow, or null."""
    d = labelled(pages, rules, labels)
    d = judged(d, fit(d))
    return d.select("page_id", "url", "host", "path", "rule", "block_probability", F.coalesce("decided", "own").alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
