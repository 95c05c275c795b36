"""Sources and sinks (A2-A5): text tables as CSV or Parquet, documents as JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagoscope.sources import split_csv
from pagoscope.sources.checkpoint import scratch_path  # noqa: F401  used as files.scratch_path
from pagoscope.sources.layout import ROW_ID, blank_tokens_to_null, conform, payments_schema

# A quote inside a quoted field is doubled; white space belongs to the value; a record
# ends with a line feed outside quotes, so line breaks of any kind survive inside them.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    na_tokens: tuple[str, ...] = ("",),
    multi_line: bool = True,
    split: bool | None = None,
) -> DataFrame:
    """A2: an all-text CSV with header; never inferred.

    Columns are found by their names in the header, in any order. Of ``schema`` (the
    payments layout unless given), columns that the file lacks become NULL; columns that
    it has besides are kept, as text, behind them. All files of a folder must have the
    same header: one that deviates fails the read instead of being misread.

    ``na_tokens`` says which texts mean NULL; ``layout.NA_TOKENS`` is the list a pandas
    reader uses. Line breaks inside quotes are read as such; ``multi_line=False`` gives
    that up for files known to have none. With line breaks, files of over ``SPLIT_OVER``
    input partitions are read by many tasks (``split_csv``), at the price of more passes over
    the text; ``split`` asks for that (True) or for one task per file (False).
    """
    options = {**CSV_OPTIONS, "multiLine": str(multi_line).lower()}
    names = spark.read.options(**options).csv(path).columns
    if multi_line and (_worth_splitting(spark, path) if split is None else split):
        rows = split_csv.read(spark, path, names, options)
    else:
        header = T.StructType([T.StructField(name, T.StringType(), True) for name in names])
        rows = spark.read.schema(header).option("enforceSchema", "false").options(**options).csv(path)
    if schema is None:
        wanted = [T.StructField(ROW_ID, T.LongType())] if ROW_ID in names else []
        wanted += list(payments_schema())
    else:
        wanted = list(schema)
    known = {field.name for field in wanted}
    frame = rows.select(
        *[
            (F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted
        ],
        *[F.col(f"`{name}`") for name in names if name not in known],
    )
    return blank_tokens_to_null(frame, na_tokens)


SPLIT_OVER = 4  # partitions: the split read makes up to three passes over the text


def _worth_splitting(spark: SparkSession, path: str) -> bool:
    """Whether a file keeps one task busy for long; only sizes are looked up."""
    most = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    number, unit = re.fullmatch(
        r"(\d+)\s*([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()
    ).groups()
    return most > SPLIT_OVER * int(number) * 1024 ** " kmgtp".index(unit or " ")


def write_csv(frame: DataFrame, path: str) -> None:
    """A3: CSV with header, NULL as an empty field; replaces the output."""
    frame.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A payments table in the columnar format, brought to the layout."""
    return conform(spark.read.parquet(path))


def write_parquet(frame: DataFrame, path: str) -> None:
    """The default sink; replaces the output."""
    frame.write.mode("overwrite").parquet(path)


def read_json_document(
    spark: SparkSession, path: str, schema: T.StructType | str, indented: bool = False
) -> DataFrame:
    """A4: JSON documents by a stated schema, one per line or one indented file."""
    return spark.read.schema(schema).option("multiLine", str(indented).lower()).json(path)


def write_json_document(frame: DataFrame, path: str) -> None:
    """A5: one JSON object per line; non-ASCII text is kept as it is."""
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def preview(frame: DataFrame, order_by: str, rows: int = 3) -> DataFrame:
    """The first rows by a stated order."""
    return frame.orderBy(F.col(order_by)).limit(rows)
