"""Reading and writing: tab-separated lists, the catalog, the published corpus, CSV."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import chunk_of


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; in local mode, where that is unset, a local temporary one. It goes with the session's JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/loomwork-scratch"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/files-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", comment="#", schema=schema)
    return df.select(*[F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).where(F.coalesce(df.columns[0], F.lit("")) != "")


def build_catalog(candidates: DataFrame, connections: DataFrame) -> DataFrame:
    """Candidates with their connection: connected ones enabled, others generic and disabled. A connection of nobody is an error."""
    orphans = connections.join(candidates, "company", "left_anti").limit(5).collect()
    if orphans:
        raise ValueError(f"connections without a company: {[r.company for r in orphans]}")
    j = candidates.join(connections, "company", "left")
    return j.select(*[F.col(c) for c in candidates.columns], F.coalesce("platform", F.lit("generic")).alias("platform"), "slug", F.col("platform").isNotNull().alias("enabled"))


#: The layout of published tables; a corpus of another one is refused.
SCHEMA_VERSION = 1


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions published under a path, oldest first: those whose manifest is complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit() and _there(spark, f"{path}/manifests/{n}/_SUCCESS"))


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], version: int | None = None, partitions: dict[str, str] | None = None) -> int:
    """Writes tables into a folder of a new version and its manifest last, so a reader sees all of a version or the one before.

    A version that is given and was published already stays as it is: writing it again changes nothing.
    """
    done = versions(spark, path)
    version = (done[-1] + 1 if done else 0) if version is None else version
    if version in done:
        return version
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partitions[name]) if partitions and name in partitions else w).parquet(f"{path}/versions/{version}/{name}")
    manifest = spark.createDataFrame([(version, SCHEMA_VERSION, sorted(tables))], "version int, schema int, tables array<string>")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifests/{version}")
    return version


def read_published(spark: SparkSession, path: str, schemas: dict[str, str], version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version, the newest unless one is named (or the newest up to it); a table that it lacks is empty. A manifest of another schema is an error."""
    done = [v for v in versions(spark, path) if version is None or v <= version]
    if not done:
        return {name: spark.createDataFrame([], ddl) for name, ddl in schemas.items()}
    m = spark.read.schema("version int, schema int, tables array<string>").json(f"{path}/manifests/{done[-1]}").first()
    if m.schema != SCHEMA_VERSION:
        raise ValueError(f"{path} has schema {m.schema}, not {SCHEMA_VERSION}")
    return {name: spark.read.schema(ddl).parquet(f"{path}/versions/{done[-1]}/{name}") if name in m.tables else spark.createDataFrame([], ddl) for name, ddl in schemas.items()}


def write_corpus(live: DataFrame, state: DataFrame, bodies: DataFrame, path: str, file_bytes: int = 256 << 20) -> int:
    """Publishes live and state, and bodies of live ids only, partitioned by id chunk; a chunk has as many files, and tasks, as its bytes ask for."""
    kept = bodies.join(live.select("id"), "id", "left_semi").withColumn("chunk", chunk_of(F.col("id")))
    size = kept.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-size // (16 * file_bytes)))
    salt = F.pmod(F.xxhash64("id"), F.lit(parts))
    return publish(live.sparkSession, path, {"live": live, "state": state, "bodies": kept.repartition(16 * parts, F.col("chunk"), salt)}, partitions={"bodies": "chunk"})


def read_corpus(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of the newest version; a missing one is empty."""
    return read_published(spark, path, schemas)


def export_csv(tracked: DataFrame, path: str) -> None:
    """Applied first, then saved, newest first; line ends to spaces."""
    flat = [F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in tracked.dtypes]
    tracked.select(*flat).orderBy(F.desc_nulls_last("applied_at"), F.desc_nulls_last("saved_at"), "key").write.mode("overwrite").csv(path, header=True, quote='"', escape='"', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
