"""Batches of observed postings as a stream: each micro-batch is merged into the published table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import reconcile_removals
from ..sources import corpus


def fold_batch(stored: DataFrame, batch: DataFrame, as_of, threshold: int = 2) -> DataFrame:
    """Seen rows become active now, new ones enter, unseen ones of companies in the batch move towards removal."""
    seen = batch.groupBy("key").agg(F.max("company").alias("company"), F.max("last_seen").alias("_seen"))
    moved = reconcile_removals(stored, seen, as_of, threshold)
    j = moved.join(seen.select("key", "_seen"), "key", "left")
    hit = F.col("_seen").isNotNull()
    old = j.select("key", "company", F.coalesce("_seen", "last_seen").alias("last_seen"), F.when(hit, "active").otherwise(F.col("status")).alias("status"), F.when(hit, 0).otherwise(F.col("missed")).alias("missed"), F.when(~hit, F.col("removed_at")).alias("removed_at"))
    new = seen.join(stored.select("key"), "key", "left_anti").select("key", "company", F.col("_seen").alias("last_seen"), F.lit("active").alias("status"), F.lit(0).alias("missed"), F.lit(None).cast("timestamp").alias("removed_at"))
    return old.unionByName(new)


STORED = "key string, company string, last_seen timestamp, status string, missed int, removed_at timestamp"


def run_versions(spark: SparkSession, landing: str, schema: str, path: str, checkpoint: str) -> StreamingQuery:
    """As run, with the table in published versions (see corpus.publish): epoch e folds its batch into version e and publishes e + 1.

    So an epoch that comes again, after a failure between publishing and the stream's own checkpoint, folds the same batch
    into the same version and finds its result published: nothing changes. Batches without rows publish their base again.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        fold_epoch(spark, batch, epoch, path)

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_epoch(spark: SparkSession, batch: DataFrame, epoch: int, path: str) -> None:
    base = corpus.read_published(spark, path, {"stored": STORED}, version=epoch)["stored"]
    now = batch.agg(F.max("last_seen")).first()[0]
    corpus.publish(spark, path, {"stored": base if now is None else fold_batch(base, batch, F.lit(now))}, version=epoch + 1)


def run(spark: SparkSession, landing: str, schema: str, published: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Reads landed Parquet files as a stream and publishes a new version per micro-batch; ends when all is read."""

    def step(batch: DataFrame, epoch: int) -> None:
        now = batch.agg(F.max("last_seen")).first()[0]
        if now is not None:
            publish(fold_batch(published(), batch, F.lit(now)), epoch)

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
