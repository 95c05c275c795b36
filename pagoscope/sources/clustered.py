"""Zones clustered by payment id, so that what counts by id moves no row.

Two tables hold the rows. ``<table>`` is bucketed and sorted by ``payment_id`` and partitioned
by zone: a reader that groups or joins by id starts from the buckets, without an exchange.
``<table>_spread`` is partitioned by zone only; it takes what one bucket would gather in one
task: the rows without an id and those of the at most ``HEAVY_IDS`` most frequent repeated
ids. Any other id holds less than ``1 / HEAVY_IDS`` of the table. The exchange by id is
paid once, by the writer.

Choose ``buckets`` by size, so that a bucket is what one task should read (256 MB, say).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagoscope.operators import reports
from pagoscope.operators.findings import HOT_IDS as HEAVY_IDS
from pagoscope.sources.checkpoint import written
from pagoscope.sources.zones import ZONE

ID = "payment_id"


def spread_table(table: str) -> str:
    return f"{table}_spread"


def write(rows: DataFrame, table: str, location: str, buckets: int = 200,
          heavy_ids: int = HEAVY_IDS) -> None:
    """Cluster rows that have a ``zone``, such as those of ``zones.read_zones``.

    The rows are read three times, the first time their ids only: give a written table.
    An existing table of the name is replaced.
    """
    if not 0 <= heavy_ids <= HEAVY_IDS:
        raise ValueError(f"heavy_ids must lie between 0 and {HEAVY_IDS}: the list is broadcast")
    with_id = rows.where(F.col(ID).isNotNull())
    counts = with_id.groupBy(ID).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    heavy = F.broadcast(written(counts.orderBy(F.desc("_n"), ID).limit(heavy_ids).select(ID), "heavy"))
    spread = rows.where(F.col(ID).isNull()).unionByName(with_id.join(heavy, ID, "left_semi"))
    # the exchange deals by the hash of the buckets: each task writes one bucket
    even = with_id.join(heavy, ID, "left_anti").repartition(buckets, ID)
    _save(spread.write, spread_table(table), f"{location}/spread")
    _save(even.write.bucketBy(buckets, ID).sortBy(ID), table, f"{location}/buckets")


def _save(writer, table: str, path: str) -> None:
    writer.mode("overwrite").partitionBy(ZONE).option("path", path).format("parquet").saveAsTable(table)


def parts(spark: SparkSession, table: str, zone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The bucketed rows and the spread ones, of one zone or both."""
    both = spark.table(table), spark.table(spread_table(table))
    return tuple(t.where(F.col(ZONE) == zone) for t in both) if zone else both


def read(spark: SparkSession, table: str, zone: str | None = None) -> DataFrame:
    """All rows, as they were written."""
    even, spread = parts(spark, table, zone)
    return even.unionByName(spread)


def duplicate_counts(spark: SparkSession, table: str) -> DataFrame:
    """E3 by id: ids that occur more than once, with their payments. Only the counts of
    the heavy ids are exchanged, a row per id and task."""
    return _counts(*parts(spark, table)).where("affected_records > 1")


def _counts(even: DataFrame, spread: DataFrame) -> DataFrame:
    def of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(ID).agg(F.count(F.lit(1)).alias("affected_records"))

    return of(even).unionByName(of(spread.where(F.col(ID).isNotNull())))


def duplicate_rows(spark: SparkSession, table: str) -> DataFrame:
    """E3 at row level: the payments behind duplicate ids. Spread rows with an id belong to
    repeated ids by construction; the others meet their count within their bucket."""
    even, spread = parts(spark, table)
    repeated = even.groupBy(ID).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(ID)
    return spread.where(F.col(ID).isNotNull()).unionByName(even.join(repeated, ID, "left_semi"))


def batch_profile(spark: SparkSession, table: str) -> DataFrame:
    """H15 from the clustered zones: ids are counted where they lie."""
    even, spread = parts(spark, table)
    return reports.profile_of(reports.per_id(even).unionByName(reports.per_id(spread)))
