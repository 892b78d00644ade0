"""Files that the driver and all executors share, between the steps of a job."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). Where it is unset, a local session,
    which has no other machine, gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: The parts that an application's tables are dealt into by table_uid.
_parts: dict[str, int] = {}


def deal(spark: SparkSession, n: int) -> None:
    """From now on tables of the application are dealt by table_uid into so many parts (kept_by_table), and the session joins
    what is dealt by table_uid on further columns as well without dealing it again. Files in buckets hold about 16 times as
    much as they measure; without being told, Spark would broadcast them by their measure."""
    _parts[spark.sparkContext.applicationId] = n
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "16")


def parts(spark: SparkSession) -> int | None:
    return _parts.get(spark.sparkContext.applicationId)


def bucketed(name: str, n: int, *dfs: DataFrame) -> DataFrame:
    """The rows of all dfs, of the same columns, written to the shared folder as the table `name`, in buckets of table_uid."""
    spark = dfs[0].sparkSession
    for df in dfs:
        df.write.mode("append").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(n, "table_uid").saveAsTable(name)
    return spark.table(name)


def kept_by_table(*dfs: DataFrame) -> DataFrame:
    """The union of dfs kept, in buckets of table_uid, for rows that come dealt by it: windows, groupings and joins of them by
    table then move nothing. Rows dealt in another way are bucketed too, in more and smaller files."""
    n = parts(dfs[0].sparkSession)
    return bucketed(f"kept_{uuid.uuid4().hex}", n, *dfs) if n else kept(functools.reduce(DataFrame.unionByName, dfs))


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, for plans that read it several times: nothing stays in memory, and what a
    lost executor held is read again."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
