"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, where the driver and all executors see it.

    It lies below ``spark.checkpoint.dir``; where that is unset, as in tests, below
    the session's warehouse, which is shared by definition.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame below the shared folder and read it back: its lineage ends there,
    so a lost executor costs a read and not the work before."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def documents(docs: DataFrame) -> DataFrame:
    """Only the id and the text: other columns, whatever their names, never interfere."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_rows(docs: DataFrame) -> Column:
    """All columns as one struct, so that their names cannot clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def numbered(docs: DataFrame) -> DataFrame:
    """The columns under plain names c0, c1, ..., which Python functions over rows need."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices, so that a task holds few texts as Python objects at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def labelled_rows(remainder_of: int) -> Column:
    """crc32 of the id as text, modulo ``remainder_of``: the held-out rule of the queries."""
    return F.crc32(F.col("doc_id").cast("string")) % remainder_of


def find_package(spark: SparkSession) -> None:
    """Let Python workers that start later find this package where the driver found it; on
    a cluster it is installed on every machine instead, and the path does no harm."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def dealt(counts: dict, total: int, least: int = 1) -> dict:
    """``total`` rows dealt out to labels with so many rows each: evenly, what a small label
    leaves goes to the others; none gets less than ``least`` while it has them."""
    quota, left = {}, total
    for i, label in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        quota[label] = min(counts[label], max(least, left // (len(counts) - i)))
        left = max(0, left - quota[label])
    return quota


def sampled(keys: DataFrame, quotas: Callable[[dict], dict]) -> tuple[DataFrame, dict]:
    """Of distinct ``keys`` (label, h and more) the rows of smallest ``h`` by label, as many as
    ``quotas`` says for the counts by label; and these counts.

    As ``h`` is a uniform hash, all but a few rows more than the quotas are left out where
    they are read; no label's rows gather in a task, and the driver gets the sample alone.
    """
    table = written(keys, "keys")
    spark, kind = table.sparkSession, table.schema["label"].dataType.simpleString()
    counts = dict(table.groupBy("label").count().collect())
    quota = quotas(counts)
    most = [
        (label, min(2**63 - 1, -2**63 + 2**64 * int(n + 8 * n**0.5 + 8) // counts[label]))
        for label, n in quota.items()
    ]
    few = table.join(F.broadcast(spark.createDataFrame(most, f"label {kind}, most long")), "label")
    left, chosen = dict(quota), []
    for row in sorted(few.where("h <= most").select(*table.columns).collect(), key=lambda r: r["h"]):
        if left[row["label"]] > 0:
            left[row["label"]] -= 1
            chosen.append(row)
    return spark.createDataFrame(chosen, table.schema), counts
