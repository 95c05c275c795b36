"""Written intermediate tables, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the session names.

    ``spark.checkpoint.dir`` must be set when the session starts, to a folder that the
    driver and every executor see; a machine-local folder would lose rows on a cluster.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/pagoscope/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame and read it back: its lineage ends there, and what is read later does
    not depend on a task being run again the same way."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
