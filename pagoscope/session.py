"""Session settings the library expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.
#
# hugeMethodLimit: the JVM never compiles a method over 8,000 bytes to machine
# code, and fourteen rules fused into one whole-stage method exceed that. With
# this limit Spark runs such a stage operator by operator, each still generated
# code but split into small methods (measured: 2-3x faster).
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagoscope")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    # one machine shares its own disk; a cluster names a folder that all its machines see
    builder = builder.config(
        "spark.checkpoint.dir", os.environ.get("PAGOSCOPE_SCRATCH") or tempfile.mkdtemp(prefix="pagoscope-")
    )
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
