"""URL filters: rules first, then gradient-boosted trees on lexical features, in DataFrame functions only.

Features of a url: lengths, depth, digit ratio, entropy of its characters, parameters, hyphens and labels of the host, and smoothed block
rates of the host's last two and last three labels in the training rows (suffix statistics). A training row's own rates come from the other FOLDS - 1 folds, so its
label isn't among its features. The trees are Spark ML's, trained on at most TRAIN_ROWS labelled urls in hash order. The operator takes labelled urls; the query labels
its own by what the pages say, in their html, which no feature reads.

Scale: one pass over the urls; rules are an array literal tested in place, so no url is shuffled for them. The suffix
statistics have at most 2 * TRAIN_ROWS rows and are broadcast on that bound.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; repeated urls are judged alike, and null ids are kept; of rules of one length
that fit the first by code point counts; a probability of 0.5 blocks; urls of any length are read whole; with no labelled urls of both kinds what no rule decides is allowed; an empty table gives an
empty result; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquill.llm.common import hash_sample, prepare, read, settled, write_table

# The rules of the contract, and words by which the query labels its training urls where a page's html has them.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BAD_WORDS = ("casino", "pills", "bets", "adult", "spam", "ads-track")

TRAIN_ROWS, FOLDS = 20_000, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    part = lambda k: F.coalesce(F.regexp_extract(url, SHAPE, k), F.lit(""))
    return df.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def best_rule(rules, host: Column, path: Column) -> Column:
    """Struct of rule and action of the longest rule that fits, or null."""
    listed = F.array(*[
        F.struct(F.lit(rule.partition("/")[0]).alias("host"), F.lit("/" + rule.partition("/")[2]).alias("path"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    ])
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.get(F.filter(listed, fits), F.lit(0))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def features(df: DataFrame) -> DataFrame:
    """Adds the lexical features f_* and the suffixes s2, s3 for url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    share = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    out = {
        "f_length": F.length(url), "f_host": F.length("host"), "f_path": F.length("path"), "f_depth": _count(F.col("path"), "/"),
        "f_digits": F.regexp_count(url, F.lit("[0-9]")) / n, "f_host_digits": F.regexp_count("host", F.lit("[0-9]")),
        "f_entropy": F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
        "f_params": F.when(query == "", 0).otherwise(1 + _count(query, "&")), "f_hyphens": _count(F.col("host"), "-"), "f_labels": _count(F.col("host"), ".") + 1,
    }
    return df.withColumns({k: v.cast("double") for k, v in out.items()}).withColumns({"s2": F.substring_index("host", ".", -2), "s3": F.substring_index("host", ".", -3)})


FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_digits", "f_host_digits", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_s2", "f_s3"]


def suffix_rates(train: DataFrame, key: str, prior: float, strength: float = 5.0) -> DataFrame:
    """key, fold, f_key: the smoothed block rate of each suffix without the fold's rows, and with all rows where fold is null."""
    rate = lambda y, n: (y + prior * strength) / (n + strength)
    folds = train.groupBy(key, "fold").agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n"))
    whole = folds.groupBy(key).agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"))
    apart = folds.join(whole, key).select(key, "fold", rate(F.col("all_y") - F.col("y"), F.col("all_n") - F.col("n")).alias(f"f_{key}"))
    return apart.union(whole.select(key, F.lit(None).cast("int").alias("fold"), rate(F.col("all_y"), F.col("all_n")).alias(f"f_{key}")))


class UrlModel:
    def __init__(self, labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 4) -> None:
        """labelled: url, label (0 or 1); rows of other labels don't train."""
        few = hash_sample(labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("double").alias("label")), rows, "url")
        train = write_table(features(split_url(few)).withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(FOLDS)).cast("int")), "url_train")
        seen = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("rate")).first()
        self.prior, self.model = seen["rate"], None
        if 0 < self.prior < 1:
            self.rates = {k: write_table(suffix_rates(train, k, self.prior), f"url_{k}") for k in ("s2", "s3")}
            made = self.vectors(train).select("features", "label").coalesce(4)
            self.model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, checkpointInterval=-1).fit(made)

    def vectors(self, df: DataFrame) -> DataFrame:
        """df with features; training rows, which have a fold, by the rates of the other folds."""
        on = ["fold"] if "fold" in df.columns else []
        for key, rates in self.rates.items():  # at most (FOLDS + 1) * TRAIN_ROWS rows each
            rates = rates.where("fold is not null") if on else rates.where("fold is null").drop("fold")
            df = df.join(F.broadcast(rates), [key, *on], "left").withColumn(f"f_{key}", F.coalesce(F.col(f"f_{key}"), F.lit(self.prior)))
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)

    def score(self, df: DataFrame) -> DataFrame:
        """df (with url, host, path) and p_block."""
        if self.model is None:
            return df.withColumn("p_block", F.lit(0.0))
        names = df.columns
        out = self.model.transform(self.vectors(features(df)))
        return out.select(*names, vector_to_array("probability")[1].alias("p_block"))


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every page."""
    scored = model.score(split_url(pages.select("page_id", "url")))
    return scored.withColumn("best", best_rule(rules, F.col("host"), F.col("path"))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block",
    )


def labelled_urls(pages: DataFrame) -> DataFrame:
    """Training labels of the query: 1 where the page's html has one of BAD_WORDS. Pages without html don't train."""
    return pages.select("url", F.lower("html").rlike("|".join(BAD_WORDS)).cast("int").alias("label"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = read(prepare(spark), sf_dir, "pages")
    return settled(spark, lambda: judge(pages, UrlModel(labelled_urls(pages))), "url_verdicts")
