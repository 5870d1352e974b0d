"""An inverted index of postings for searches by keyword and skill, equal to the scanning predicate of `filters`.

Three tables under a path. `terms` has a row (kind, term, id) for each whole word of the long fields (w), and for each run
of one to three characters of the short fields (s) and of what skills are looked for in (k), where tokens are substrings.
It lies in folders by kind and by a hash of the term, so a search reads the few folders of its own terms; rows of one term
are spread over `files` files, so a word that every posting has is no one task's. `texts` has the short texts themselves
by a hash of the id: runs of characters only propose postings, and a substring is looked up in the texts of those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import once
from .filters import ARRAYS, LONG, SHORT, SIGNS

BUCKETS = 32
SKILLED = ("keywords", "snippet")
BETWEEN = "\x1f"


def _tag(kind: str):
    return lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("term"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _text(fields: tuple[str, ...]) -> Column:
    """The fields in lower case, so apart that nothing is found across two of them."""
    one = lambda c: F.lower(F.coalesce(F.array_join(c, ", ") if c in ARRAYS and fields == SKILLED else F.array_join(c, " ") if c in ARRAYS else F.col(c), F.lit("")))
    return F.concat_ws(BETWEEN, *[one(c) for c in fields])


def _runs(text: Column) -> Column:
    """Distinct runs of one to three characters."""
    def cut(chars: Column) -> Column:
        return F.array_distinct(F.concat(F.filter(chars, lambda c: c != ""), _joined(chars, 2), _joined(chars, 3)))

    return once(F.split(text, ""), cut)


def _joined(chars: Column, n: int) -> Column:
    """Each character with the n - 1 that follow it, where there are so many."""
    own = F.transform(chars, lambda c, i: F.when(i + n <= F.size(chars), F.array_join(F.slice(chars, i + 1, n), "")))
    return F.array_compact(own)


def build(df: DataFrame, path: str, short: tuple[str, ...] = SHORT, long: tuple[str, ...] = LONG, files: int = 4, kinds: str = "wsk") -> None:
    """Writes the index of df(id, fields); a null field is empty, a null id is found like any other. `kinds`: searches by keywords alone need w and s, searches by skills alone k."""
    words = F.array_distinct(F.split(F.translate(_text(long), SIGNS + BETWEEN, " " * (len(SIGNS) + 1)), " "))
    terms = {"w": lambda: F.filter(words, lambda w: w != ""), "s": lambda: _runs(_text(short)), "k": lambda: _runs(_text(SKILLED))}
    tagged = [F.transform(terms[kind](), _tag(kind)) for kind in kinds]
    rows = df.select("id", F.explode(F.concat(*tagged)).alias("t")).select("id", "t.kind", "t.term")
    # the bucket is worked out on either side of the shuffle and not carried
    dealt = rows.repartition(F.col("kind"), _bucket(F.col("term")), F.pmod(F.xxhash64("id"), F.lit(files))).withColumn("bucket", _bucket(F.col("term")))
    dealt.sortWithinPartitions("kind", "bucket", "term").write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{path}/terms")
    texts = df.select("id", _text(short).alias("s"), _text(SKILLED).alias("k"), F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    texts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/texts")


def _terms(spark: SparkSession, path: str, kind: str, wanted: list[str]) -> DataFrame:
    """(id, term) of the wanted terms: only their folders are read."""
    at = sorted({r.b for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(_bucket(F.col("w")).alias("b")).collect()})
    return spark.read.parquet(f"{path}/terms").where((F.col("kind") == kind) & F.col("bucket").isin(*at) & F.col("term").isin(*wanted)).select("id", "term")


def _holding(spark: SparkSession, path: str, kind: str, token: str) -> DataFrame:
    """Ids whose text of a kind holds a token: all its runs propose, the text decides (for up to three characters the run itself does)."""
    runs = sorted({token[i : i + 3] for i in range(len(token) - 2)}) if len(token) > 3 else [token]
    found = _terms(spark, path, kind, runs).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(runs)).select("id")
    if len(token) <= 3:
        return found
    texts = spark.read.parquet(f"{path}/texts").select("id", kind)
    return texts.join(found, texts["id"].eqNullSafe(found["id"]), "left_semi").where(F.contains(kind, F.lit(token))).select("id")


def search(spark: SparkSession, path: str, keyword: str = "", skills: tuple[str, ...] = ()) -> DataFrame | None:
    """The ids that a keyword search finds with all of the skills, as `filters.predicate` in strict mode; None if nothing is asked for."""
    parts = []
    for token in dict.fromkeys(keyword.lower().split()):
        # a token with one of the signs that part words is no word
        whole = _terms(spark, path, "w", [token]).select("id") if not set(token) & set(SIGNS) else None
        held = _holding(spark, path, "s", token)
        parts.append((held if whole is None else held.unionByName(whole)).distinct())
    parts += [_holding(spark, path, "k", s.lower()).distinct() for s in dict.fromkeys(skills)]
    if not parts:
        return None
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).select("id")
