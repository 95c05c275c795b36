"""A1: payments from a relational system of record, read in parallel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pagoscope.sources.layout import SOURCE_COLUMNS, rename_source


@dataclass(frozen=True)
class JdbcSource:
    """Where and how to read.

    ``partition_column`` with its bounds splits the scan into ``partitions``
    range queries. Without it one connection and one task would carry the whole
    table, which a caller has to ask for with ``one_connection``.
    """

    url: str
    table: str
    partition_column: str | None = None
    lower_bound: str | int | None = None
    upper_bound: str | int | None = None
    partitions: int = 64
    fetch_size: int = 10_000
    one_connection: bool = False
    properties: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        chosen = {
            "url": self.url,
            "dbtable": self.table,
            "fetchsize": str(self.fetch_size),
            **self.properties,
        }
        if self.partition_column is None:
            if not self.one_connection:
                raise ValueError("name a partition column, or ask for one_connection")
            return chosen
        if self.lower_bound is None or self.upper_bound is None:
            raise ValueError("a partition column needs a lower and an upper bound")
        return {
            **chosen,
            "partitionColumn": self.partition_column,
            "lowerBound": str(self.lower_bound),
            "upperBound": str(self.upper_bound),
            "numPartitions": str(self.partitions),
        }


def read_payments(spark: SparkSession, source: JdbcSource) -> DataFrame:
    """Scan and rename; only the projected columns leave the database."""
    scanned = spark.read.format("jdbc").options(**source.options()).load()
    wanted = [c for c in dict.fromkeys(SOURCE_COLUMNS.values()) if c in scanned.columns]
    return rename_source(scanned.select(*wanted))
