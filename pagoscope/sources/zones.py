"""The clean and errors zones, written once and replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from pagoscope.sources.files import CSV_OPTIONS
from pagoscope.sources.layout import ERRORS_COLUMN

ZONE = "zone"
CLEAN, ERRORS = "clean", "errors"
_EVALUATION = ("critical", "warning", "is_error")


def write_zones(evaluated: DataFrame, path: str, file_format: str = "parquet") -> Observation:
    """Write both zones from one evaluation.

    Two filtered writes would evaluate every rule twice; one write partitioned
    by zone evaluates once, and a reader of one zone never opens the other. The
    zone counts are observed while writing and cost no pass of their own. The
    write replaces its own path only.
    """
    counts = Observation("zones")
    routed = evaluated.observe(
        counts,
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_error").alias("error_records"),
        F.count_if(F.col("warning") != "").alias("warning_records"),
    ).withColumn(ZONE, F.when(F.col("is_error"), ERRORS).otherwise(CLEAN))
    writer = routed.drop(*_EVALUATION).write.mode("overwrite").partitionBy(ZONE)
    if file_format == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(file_format).save(path)
    return counts


def read_zones(
    spark: SparkSession, path: str, file_format: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Both zones as one table (F1) with the ``zone`` column for pruning."""
    reader = spark.read.format(file_format)
    if schema is not None:
        reader = reader.schema(schema)
    if file_format == "csv":
        reader = reader.options(**CSV_OPTIONS)
    return reader.load(path)


def clean_rows(zones: DataFrame) -> DataFrame:
    """The clean zone of :func:`read_zones`, in the payments layout."""
    return zones.where(F.col(ZONE) == CLEAN).drop(ZONE, ERRORS_COLUMN)


def error_rows(zones: DataFrame) -> DataFrame:
    """The errors zone of :func:`read_zones`, with ``dq_errors``."""
    return zones.where(F.col(ZONE) == ERRORS).drop(ZONE)
