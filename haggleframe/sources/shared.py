"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; where it names none, a temporary folder in local mode (tests), an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="haggleframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: later steps start from files that a lost executor doesn't take along."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/haggleframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
