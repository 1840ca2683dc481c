"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is a column expression or Spark's own boosted trees; no Python runs on the executors.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import cut, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs that the trees are fitted on, at most; the ones with the smallest hashes.
MAX_TRAINING_URLS = 20_000
TREES, DEPTH, SEED = 16, 4, 7
#: Folds of the labelled URLs; rates of a suffix come from the folds that a URL isn't in.
FOLDS = 5
#: Ends of the host, the start of the path, and both: what their other labelled URLs were called is a feature.
SUFFIXES = ("top", "site", "head", "site_head")
FEATURES = ("n_chars", "host_chars", "path_chars", "host_depth", "path_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", *(f"{s}_rate" for s in SUFFIXES))


def with_host_and_path(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null or one without '://'."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1))


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does. Equal lengths: the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(list(rules)), key=lambda r: len(r[1])):
        site, _, start = text.partition("/")
        fits = ((F.col("host") == site) | F.endswith(F.col("host"), F.lit("." + site))) & F.startswith(F.col("path"), F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the parts whose block rates are features as well."""
    url, host, path = F.col("url_text"), F.col("host"), F.col("path")
    n = F.length(url)
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    labels = F.split(host, r"\.")
    return urls.withColumns(
        {
            "n_chars": n.cast("double"),
            "host_chars": F.length(host).cast("double"),
            "path_chars": F.length(path).cast("double"),
            "host_depth": F.size(labels).cast("double"),
            "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(n, F.lit(1)),
            "entropy": F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(-share(c) * F.log(share(c)) / log(2))),
            "n_params": F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&]+")).cast("double"),
            "n_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
            "top": F.substring_index(host, ".", -1),
            "site": F.substring_index(host, ".", -2),
            "head": F.regexp_extract(path, "^/([^/]*)", 1),
        }
    ).withColumn("site_head", F.concat_ws("/", "site", "head"))


def block_rates(sample: DataFrame, suffix: str, mean: float, held_back: bool = False) -> DataFrame:
    """Block rate of each suffix in the sample, drawn to the sample's mean by one pseudo-row; held_back: for each fold, from the rows of the others."""
    rate = lambda s, n: ((s + F.lit(mean)) / (n + 1)).alias(f"{suffix}_rate")
    parts = sample.groupBy(suffix, "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    whole = parts.groupBy(suffix).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    if not held_back:
        return whole.select(suffix, rate(F.col("all_s"), F.col("all_n")))
    return parts.join(whole, suffix).select(suffix, "fold", rate(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")))


def scored_by_trees(sample: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (url_text, host, path, ...) with p, the probability of 'block', by trees learned from sample (url_text, host, path, label 0 or 1; both kinds).

    The suffix rates that a labelled URL is learned with come from the other folds, so its own label isn't among its features. The tables
    of rates are no longer than the sample, which bounds what is broadcast.
    """
    sample = cut(lexical(sample).withColumn("fold", F.pmod(F.xxhash64("url_text", F.lit(SEED)), F.lit(FOLDS))))
    mean = sample.agg(F.avg("label")).first()[0]

    def featured(df: DataFrame, held_back: bool) -> DataFrame:
        for suffix in SUFFIXES:
            on = [suffix, "fold"] if held_back else [suffix]
            df = df.join(F.broadcast(block_rates(sample, suffix, mean, held_back)), on, "left").fillna(mean, [f"{suffix}_rate"])
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, minInstancesPerNode=5).fit(cut(featured(sample, True).select("features", "label")))
    return model.transform(featured(lexical(rows), False)).withColumn("p", vector_to_array("probability")[1])


def labelled_urls(rows: DataFrame) -> DataFrame:
    """Distinct URLs that a rule decides (rule, ruled), with label 1 for 'block'."""
    return rows.where("rule is not null").select("url_text", "host", "path", (F.col("ruled") == "block").cast("double").alias("label")).dropDuplicates(["url_text"])


def ruled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, url_text, host, path, rule, ruled): the URLs, their parts, and the rule that decides and its verdict."""
    rule, verdict = fitting_rule(rules)
    rows = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url_text")), "url_text")
    return rows.withColumn("rule", rule).withColumn("ruled", verdict)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_training: int = MAX_TRAINING_URLS) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict, score (of blocking; null if a rule decided).

    The URLs that a rule decides are the labelled ones; the trees learn from at most max_training distinct ones. With labels of
    one kind only, or none, the rest gets that kind's verdict, or 'allow'. A null URL is an empty one;
    repeated rows and null ids each keep their row; an empty table gives no row; other columns are not read.
    """
    rows = ruled(pages, id_col, url_col, rules)
    sample = cut(labelled_urls(rows).orderBy(F.xxhash64("url_text"), "url_text").limit(max_training))
    kinds = {r[0] for r in sample.select("label").distinct().collect()}
    if len(kinds) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("block" if kinds == {1.0} else "allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    scored = scored_by_trees(sample, rows)
    score = F.when(F.col("rule").isNull(), F.col("p"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
