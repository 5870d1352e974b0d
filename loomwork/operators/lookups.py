"""Rows against lists of companies: sponsors and fallback urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_company, norm_key


def with_sponsor(df: DataFrame, sponsors: DataFrame, company: str = "company", risk: str = "eligibility_risk") -> DataFrame:
    """df with sponsors_h1b (true, false, or null where sponsors(name, sponsors) does not say) and h1b_accessible (known to sponsor, and no medium or high risk).

    Names meet without their noise words; a name given twice sponsors if one of its rows does.
    """
    known = sponsors.groupBy(norm_company(F.col("name")).alias("_k")).agg(F.max("sponsors").alias("sponsors_h1b"))
    out = df.withColumn("_k", norm_company(F.col(company))).join(known, "_k", "left").drop("_k")
    return out.withColumn("h1b_accessible", F.coalesce("sponsors_h1b", F.lit(False)) & ~F.coalesce(F.col(risk), F.lit("low")).isin("high", "medium"))


def fallback_url(companies: DataFrame, lookup: DataFrame, company: str = "company") -> DataFrame:
    """companies with fallback_url by lookup(ord, name, url): the whole name, else its first word, else the first name in `ord` that it holds anywhere; else empty.

    Every step is an equi-join on one key table of the distinct names: the last one on their substrings as long as some
    looked-up name, so no name is compared with the whole list.
    """
    listed = lookup.groupBy(norm_key(F.col("name")).alias("k")).agg(F.min(F.struct("ord", "url")).alias("hit")).where("k <> ''")
    lengths = listed.agg(F.array_sort(F.collect_set(F.length("k")))).first()[0]  # at most the length of the longest name
    names = companies.select(norm_key(F.col(company)).alias("_n")).where("_n <> ''").distinct()
    words = [F.struct(F.lit(1).alias("step"), F.col("_n").alias("k")), F.struct(F.lit(2).alias("step"), F.substring_index("_n", " ", 1).alias("k"))]

    def cut(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("_n") - n + 1, F.lit(1))), lambda i: F.struct(F.lit(3).alias("step"), F.substr(F.col("_n"), i, F.lit(n)).alias("k")))

    keys = names.select("_n", F.explode(F.array_distinct(F.concat(F.array(*words), *map(cut, lengths)))).alias("x")).select("_n", "x.step", "x.k")
    best = keys.join(listed, "k").groupBy("_n").agg(F.min(F.struct("step", "hit.ord", "hit.url")).alias("b")).select("_n", F.col("b.url").alias("fallback_url"))
    return companies.withColumn("_n", norm_key(F.col(company))).join(best, "_n", "left").drop("_n").withColumn("fallback_url", F.coalesce("fallback_url", F.lit("")))
