"""URL filters: listed rules, and gradient-boosted trees on lexical features for URLs that no rule names."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sampled, shared_dir, stored

FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length", "hyphens", "has_fragment", "suffix_rate", "site_rate")


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a path prefix that begins with `/`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased): after the first `://` up to `/`, `?`, `#` or the end. Path: then up to `?`, `#` or the end. Both empty without `://` and for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null; the rules are a short list of settings."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def lexical(d: DataFrame) -> DataFrame:
    """d(url, host, path) with the lexical features."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    chars = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n * F.log2((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n))
    labels = F.split("host", r"\.")
    return d.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        ((F.length(url) - F.length(F.regexp_replace(url, "[0-9]+", ""))) / n).alias("digit_ratio"),
        entropy.alias("entropy"),
        count(query, "=").cast("double").alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        count(url, "-").cast("double").alias("hyphens"),
        url.contains("#").cast("double").alias("has_fragment"),
        F.element_at(labels, -1).alias("suffix"),
        F.array_join(F.slice(labels, -1 * F.least(F.size(labels), F.lit(2)), 2), ".").alias("site"),
    )


def with_rate(d: DataFrame, key: str, unit: str, rate: float, prior: float, most: int, folder: str, folds: int = 5) -> DataFrame:
    """d(ruled, rule, url, site) with `<key>_rate`: the smoothed block rate of the labelled rows of the row's key.

    A labelled row's rate comes from the other folds only (folds by a hash of `unit`), so no row's own label is in it. A
    key whose labelled rows all carry one label gets the overall `rate`: its statistic would repeat the rule that
    labelled it. So does a key without labelled rows.
    The `most` keys with the most rows are broadcast with their rates, so no other key has more than one row in `most`;
    those meet their rates in a shuffle join, in which the rows of broadcast keys are spread by a key that no host has.
    """
    fold = F.pmod(F.xxhash64(unit, F.lit("fold")), F.lit(folds)).cast("int")
    block, labelled = F.col("ruled") == "block", F.col("ruled").isNotNull()
    sums = [F.count("*").alias("rows"), F.count("ruled").alias("n"), F.count_if(block).alias("b")]
    sums += [f for i in range(folds) for f in (F.count_if(labelled & (fold == i)).alias(f"n{i}"), F.count_if(block & (fold == i)).alias(f"b{i}"))]
    smooth = lambda b, n: (b + prior * rate) / (n + prior)
    c = F.col
    # one rate without each fold, and last that of all folds
    rates = F.array(*[smooth(c("b") - c(f"b{i}"), c("n") - c(f"n{i}")) for i in range(folds)], smooth(c("b"), c("n")))
    stats = stored(d.groupBy(key).agg(*sums).select(key, "rows", F.when((c("b") > 0) & (c("b") < c("n")), rates).alias("_r")), folder, key)
    hot = stats.orderBy(F.desc("rows"), key).limit(most).select(key, F.coalesce("_r", F.array()).alias("_hot"))
    rest = stats.where("_r is not null").join(F.broadcast(hot), key, "left_anti").select(F.col(key).alias("_k"), F.col("_r").alias("_rest"))
    d = d.join(F.broadcast(hot), key, "left")
    spread = F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string"))
    d = d.withColumn("_k", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread)).join(rest, "_k", "left")
    own = F.get(F.coalesce("_hot", "_rest"), F.when(labelled, fold).otherwise(folds))
    return d.withColumn(f"{key}_rate", F.coalesce(own, F.lit(rate))).drop("_k", "_hot", "_rest")


def featured(pages: DataFrame, rules: list[Rule], folder: str, *, page_id: str = "page_id", url: str = "url", max_suffixes: int = 2_000, prior: float = 20.0) -> tuple[DataFrame, int, float]:
    """(page_id, url, host, path, rule, ruled, site and FEATURES of each row; labelled rows; their block rate)."""
    d = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_path(F.col("url"))
    d = d.select("*", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = lexical(d.select("*", name.alias("rule"), verdict.alias("ruled")))
    total = d.where("ruled is not null").agg(F.count("*"), F.count_if(F.col("ruled") == "block")).first()
    n, rate = total[0], total[1] / total[0] if total[0] else 0.0
    # of a suffix the rows of other sites count, of a site those of other URLs
    for key, unit in (("suffix", "site"), ("site", "url")) if 0 < rate < 1 else ():
        d = with_rate(d, key, unit, rate, prior, max_suffixes, folder)
    return d, n, rate


def fit_trees(labelled: DataFrame, trees: int = 20, depth: int = 4):
    """The fitted trees on rows with FEATURES and ruled; the two labels weigh the same in all."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    y = (F.col("ruled") == "block").cast("double")
    n = labelled.groupBy(y.alias("label")).count().collect()  # two rows
    size = {r["label"]: r["count"] for r in n}
    weight = F.when(y == 1, sum(size.values()) / (2 * size.get(1.0, 1))).otherwise(sum(size.values()) / (2 * size.get(0.0, 1)))
    model = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, checkpointInterval=-1, minInstancesPerNode=5)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), model]).fit(labelled.select(*FEATURES, y.alias("label"), weight.alias("weight")).repartition(4))


def with_score(d: DataFrame, model) -> DataFrame:
    """d with score, the trees' block probability."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(d).withColumn("score", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules: list[Rule], *, page_id: str = "page_id", url: str = "url", sample_rows: int = 20_000, max_suffixes: int = 2_000, prior: float = 20.0, trees: int = 20, depth: int = 4) -> DataFrame:
    """Per row: page_id, host, path, rule (null where none fits), verdict, score (block probability by the trees).

    The URLs that rules decide are the labelled ones; at most about `sample_rows` of them, chosen by a hash of the URL,
    train the trees, with both labels weighted alike. Suffix statistics are smoothed block rates over all labelled URLs of
    the last label and of the last two labels of a host, out of fold and only where both labels occur (see with_rate);
    the rates of the `max_suffixes` most frequent of each are broadcast, the others joined. With labels of one kind only,
    the verdict is that one (allow if there are none). Null and malformed URLs have an empty host and path and are judged
    by the trees; repeated rows and null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    d, n, rate = featured(pages, rules, shared_dir(pages.sparkSession), page_id=page_id, url=url, max_suffixes=max_suffixes, prior=prior)
    if rate in (0.0, 1.0):
        constant = "block" if n and rate else "allow"
        return d.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(constant)).alias("verdict"), F.lit(1.0 if constant == "block" else 0.0).alias("score"))
    some = d.where("ruled is not null").where(sampled(F.xxhash64("url"), sample_rows, n))
    scored = with_score(d, fit_trees(some, trees, depth))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
