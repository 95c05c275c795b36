"""C1-C14 with A6 on a stream: payments arrive, zones grow, each payment exactly once.

The row rules hold no state, so a micro-batch is evaluated like a table. ``foreachBatch`` writes
it into the zones below a partition of its own, ``batch=<id>``, with dynamic overwrite: a batch
that the engine runs again after a failure, under the same id, replaces what its first attempt
left and nothing else. With the checkpoint that names the batches, that is exactly once.

A task sorts its rows by zone before it writes them, so what a task reads is kept small:
``replay`` bounds the rows of a file and gives each core a file or two in a micro-batch. A larger
table makes more micro-batches and no larger tasks.

Readers see a batch when its write is committed. The counts of each batch go beside the zones in
the same way. The checkpoint and the zones belong together: a new checkpoint starts at batch 0
again, so it needs a new path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from pagoscope.operators import quality
from pagoscope.operators.quality_rules import RULES
from pagoscope.sources.layout import conform
from pagoscope.sources.zones import CLEAN, ERRORS, ZONE

BATCH = "batch"
FILE_ROWS = 500_000  # of one file of a replayed table


def _replace(frame: DataFrame, path: str, *partitions: str) -> None:
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_batch(payments: DataFrame, batch: int, path: str, rules=RULES, as_of=None) -> None:
    """Evaluate one micro-batch and put its rows into ``<path>/zones`` and its counts into
    ``<path>/counts``; doing it again under the same number changes nothing."""
    evaluated = quality.evaluate(conform(payments), rules, as_of).withColumn(BATCH, F.lit(batch).cast("long"))
    routed = evaluated.withColumn(ZONE, F.when(F.col("is_error"), ERRORS).otherwise(CLEAN))
    _replace(routed.drop("critical", "is_error"), f"{path}/zones", BATCH, ZONE)
    rows = read_zones(payments.sparkSession, path, routed.drop("critical", "is_error").schema).where(
        F.col(BATCH) == batch
    )
    counts = rows.groupBy(BATCH).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col(ZONE) == ERRORS).alias("error_records"),
        F.count_if(F.col("warning") != "").alias("warning_records"),
    )
    _replace(counts, f"{path}/counts", BATCH)


def route(
    payments: DataFrame, path: str, checkpoint: str, rules=RULES, as_of=None
) -> DataStreamWriter:
    """The stream of payments routed into the zones below ``path``; start it with a trigger of
    your choice. A restart with the same ``checkpoint`` goes on where the last run ended."""
    def one_batch(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_batch(batch, number, path, rules, as_of)

    return payments.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).outputMode("append")


def replay(payments: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """A table as a stream: written as files of at most ``rows`` rows (``FILE_ROWS``) and taken up
    in several micro-batches, each of at most as many files as there are cores."""
    spark = payments.sparkSession
    rows = max(1, min(rows or FILE_ROWS, -(-payments.count() // 4)))  # a small table makes batches too
    payments.write.option("maxRecordsPerFile", rows).parquet(path)
    files = len(spark.read.schema(payments.schema).parquet(path).inputFiles())
    most = max(2, min(spark.sparkContext.defaultParallelism, files // 2))
    return spark.readStream.schema(payments.schema).option("maxFilesPerTrigger", most).parquet(path)


def read_zones(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Both zones with ``batch`` and ``zone``, of all batches so far."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/zones")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Total, error and warning records of each batch."""
    return spark.read.parquet(f"{path}/counts")
