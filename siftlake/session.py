"""Session builder for local runs; on a cluster the submitted configuration is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "siftlake", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables: spark.checkpoint.dir. Only where driver and executors are one
    process may it be unset; then a scratch folder serves."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def let_go(spark: SparkSession) -> None:
    """Have what finished steps have exchanged deleted now: Spark does so when the driver's memory is next cleared, perhaps hours later."""
    spark._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: read twice they are the same, and a lost executor doesn't cost the steps before."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/siftlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
