"""External tables over the zones and the score documents."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagoscope.functions import literal
from pagoscope.operators.scores import SCORE_COLUMNS
from pagoscope.sources.files import CSV_OPTIONS
from pagoscope.sources.layout import ERRORS_COLUMN, PAYMENT_COLUMNS, ROW_ID

# The columns of the two score tables
SCORES_TABLE_COLUMNS = {
    **{name: "INT" for name in SCORE_COLUMNS}, "generated_at": "STRING", "system": "STRING",
}
READINESS_TABLE_COLUMNS = {
    "data_quality_score": "INT", "cloud_readiness_score": "INT", "security_risk_score": "INT",
    "compliance_risk_score": "INT", "migration_risk_score": "INT", "readiness_general": "INT",
    "generated_at": "STRING",
}
ZONE_TABLES = ("payments_raw", "payments_clean", "payments_errors")


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def payments_columns(row_id: bool = False, errors: bool = False) -> dict[str, str]:
    columns = {ROW_ID: "BIGINT"} if row_id else {}
    columns |= {name: "STRING" for name in PAYMENT_COLUMNS}
    return columns | ({ERRORS_COLUMN: "STRING"} if errors else {})


def fresh_database(spark: SparkSession, name: str, location: str) -> str:
    """A database of a name that no other run uses; returns the name."""
    database = f"{name}_{uuid.uuid4().hex[:12]}"
    create_database(spark, database, location)
    return database


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}{where}")


def create_csv_table(spark: SparkSession, table: str, columns: dict[str, str], path: str) -> None:
    """An external table over a CSV folder with header and quoting."""
    spark.sql(
        f"CREATE TABLE {_quoted(table)} ({_columns(columns)}) USING csv "
        f"OPTIONS ({', '.join(f'{k} {literal(v)}' for k, v in CSV_OPTIONS.items())}) "
        f"LOCATION {literal(path)}"
    )


def create_json_table(spark: SparkSession, table: str, columns: dict[str, str], path: str) -> None:
    """An external table over a folder that holds one kind of document."""
    spark.sql(
        f"CREATE TABLE {_quoted(table)} ({_columns(columns)}) USING json LOCATION {literal(path)}"
    )


def create_parquet_table(spark: SparkSession, table: str, path: str) -> None:
    """An external table over a Parquet folder, with the columns of its files."""
    spark.sql(f"CREATE TABLE {_quoted(table)} USING parquet LOCATION {literal(path)}")


def create_partitioned_table(
    spark: SparkSession, table: str, columns: dict[str, str], path: str,
    partition: str = "zone", file_format: str = "parquet",
) -> None:
    """One external table over a folder with a subfolder per value of ``partition``.

    The catalog lists the partitions, so a filter on the column decides from the catalog
    which folders are opened, and their sizes alone count where the planner picks a join.
    """
    options = CSV_OPTIONS if file_format == "csv" else {}
    given = f"OPTIONS ({', '.join(f'{k} {literal(v)}' for k, v in options.items())}) " if options else ""
    spark.sql(
        f"CREATE TABLE {_quoted(table)} ({_columns(columns | {partition: 'STRING'})}) "
        f"USING {file_format} {given}PARTITIONED BY (`{partition}`) LOCATION {literal(path)}"
    )
    spark.sql(f"ALTER TABLE {_quoted(table)} RECOVER PARTITIONS")


def analyze(
    spark: SparkSession, table: str, columns: tuple[str, ...] = (), partition: str | None = None
) -> None:
    """Sizes and row counts for the planner, of the table and by partition, and
    distinct values, nulls and ranges of ``columns``. Statistics do not follow later writes:
    analyze again after a refresh."""
    name = _quoted(table)
    if partition:
        spark.sql(f"ANALYZE TABLE {name} PARTITION (`{partition}`) COMPUTE STATISTICS")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    if columns:
        listed = ", ".join(f"`{c}`" for c in columns)
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {listed}")


def _described(spark: SparkSession, what: str, key: str) -> str | None:
    rows = spark.sql(f"DESCRIBE EXTENDED {what}").collect()  # metadata: a few dozen rows
    return next((r[1] for r in rows if r[0] == key), None)


def _rows_in(statistics: str | None) -> int | None:
    found = re.search(r"(\d+) rows", statistics or "")
    return int(found.group(1)) if found else None


def table_rows(spark: SparkSession, table: str) -> int | None:
    """The row count that :func:`analyze` left in the catalog, None without one."""
    return _rows_in(_described(spark, _quoted(table), "Statistics"))


def partition_rows(spark: SparkSession, table: str, partition: str, value: str) -> int | None:
    """The same for one partition."""
    where = f"{_quoted(table)} PARTITION (`{partition}` = {literal(value)})"
    return _rows_in(_described(spark, where, "Partition Statistics"))


def null_count(spark: SparkSession, table: str, column: str) -> int | None:
    """The null count of a column that :func:`analyze` left in the catalog."""
    found = _described(spark, f"{_quoted(table)} `{column}`", "num_nulls")
    return int(found) if found and found.isdigit() else None


def create_zone_tables(
    spark: SparkSession, database: str, paths: dict[str, str], row_id: bool = False
) -> None:
    """The raw, clean and errors tables over their CSV folders.

    The zone folders are those of ``zones.write_zones``, which carry ``dq_errors`` in
    either zone.
    """
    for table in ZONE_TABLES:
        columns = payments_columns(row_id, errors=table != "payments_raw")
        create_csv_table(spark, f"{database}.{table}", columns, paths[table])


def drop_tables(spark: SparkSession, database: str, tables=ZONE_TABLES) -> None:
    """Drop the tables if they are there; files of external tables stay."""
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(f'{database}.{table}')}")


def table_exists(spark: SparkSession, database: str, table: str) -> bool:
    """Whether the table is in the catalog; a missing database counts as no."""
    if not spark.catalog.databaseExists(database):
        return False
    return spark.catalog.tableExists(f"{database}.{table}")


def table(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(f"{database}.{name}")
