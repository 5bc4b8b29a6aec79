"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only when a session of one machine (``local``) names no shared folder.
LOCAL_SHARED_DIR = "/tmp/glossmark-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; only a session on one machine may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or LOCAL_SHARED_DIR).rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder, in one folder for each value of ``by``, and reads it back.

    Cuts the lineage: later jobs, retries after lost executors included, read the table instead of running the plan again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
