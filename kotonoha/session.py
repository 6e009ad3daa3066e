"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kotonoha")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # a call to the JVM less for each expression
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a temporary folder only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), "kotonoha-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of a row group as Parquet writers make them; a row group is read by one task.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores where Spark's estimate of their size gives a core less than a row group, else df as it is.

    For work that costs far more than moving its rows: a table in one row group would be one task. Larger tables have row groups enough and are not moved."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * ROW_GROUP else df


def written(df: DataFrame, name: str = "cut", file_rows: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and a lost executor costs no recomputation.

    file_rows: the most rows of a file (0: any number), for large rows that few tasks write and more shall read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
