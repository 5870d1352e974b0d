"""Tables written to the folder that the driver and all executors share, and connected components over edges."""

from __future__ import annotations

import tempfile
import uuid
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; in local mode, where that is unset, under a local temporary one.

    The folder goes when the session's JVM ends. On a cluster the setting is required: a machine's own temporary folder
    would scatter the data.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/loomwork-shared"
    out = f"{base.rstrip('/')}/loomwork-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return out if "://" in out else str(fs.makeQualified(path).toString())


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df, written once as Parquet and read again: cuts lineage and survives lost executors."""
    out = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def sampled(key: Column, wanted: int, total: int) -> Column:
    """Whether a row is one of about `wanted` of `total` rows: its 64-bit hash `key` lies below that share of all values."""
    if wanted >= total:
        return F.lit(True)
    return key < F.lit(int(Fraction(wanted, total) * (1 << 64)) - (1 << 63))


def connected_components(edges: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) longs; the component is its least node.

    Alternates large-star and small-star rounds: each node with its neighbours is re-hung on the least of them, so a
    component becomes a star after about log(size) rounds. Rows stay at most the number of edges. Self-loops are
    ignored; nodes without edges do not appear; an empty table gives no rows.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges")
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, folder, "large")
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        cur = stored(small.select("e.a", "e.b").where("a <> b").distinct(), folder, "edges")
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
