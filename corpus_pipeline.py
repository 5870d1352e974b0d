"""A corpus from raw documents to packed sequences: each stage calls one operator of loomwork.llm on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, language, near_duplicates, packing, toxicity
from loomwork.llm.queries import _path
from loomwork.llm.shared import shared_dir, stored

#: A text whose likeliest language has a smaller mean probability than this has no language.
LEAST_LANGUAGE = 0.3


def _columns(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from an operator's result that took them along."""
    return scored.select(*[F.col(c if c in ("doc_id", "text") else f"_{c}").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null and empty texts are scored like texts without words; repeated rows and null ids are judged each for itself.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(toxicity.score(docs, model, keep=docs.columns).where("predicted = 0"), docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a clear language, go: null and empty texts with them.

    Repeated rows and null ids are judged each for itself; a table without any language loses all rows.
    """
    net = language.train(docs)
    return _columns(language.identify(docs, net, keep=docs.columns).where(F.col("lang_pred") != "und").where(F.col("score") >= LEAST_LANGUAGE), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays.

    Null, empty and wordless texts are no one's duplicates and stay. Rows that repeat an id are compared each by its own
    text; of a class with null ids one row stays too, one with an id if there is any.
    """
    return near_duplicates.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts stay; each row is judged by its own text, so repeated and null ids need no care. No row is joined
    or moved while the benchmark fits in the operator's broadcast.
    """
    marked = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns)
    return _columns(marked.where("n_hit = 0"), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 1024 tokens; null and empty texts are an end id alone, repeated rows are packed each for itself."""
    return packing.packed(docs, _path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("language", languages), ("near_duplicates", near_copies), ("decontamination", benchmark_leaks), ("packing", sequences)]
#: Trained classifiers and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again. An empty table gives an empty result."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
