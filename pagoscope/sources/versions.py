"""Outputs that are replaced as a whole, or not at all.

A run writes its outputs into a folder of its own, ``<output>/versions/<id>``. Only when all of
them are there, one line in ``<output>/manifest`` publishes the run: a single small file, which
appears at once or not at all. Readers look up the newest line and read the folders that it
names, so a run that breaks half way leaves the last published outputs as they were, and a
reader that has started keeps the folders that it resolved. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "number LONG, version STRING, outputs MAP<STRING, STRING>, notes MAP<STRING, STRING>"


@dataclass(frozen=True)
class Version:
    """A published run: paths by output name, and notes that its writer left."""

    number: int
    version: str
    outputs: dict[str, str]
    notes: dict[str, str]


def _manifest(output: str) -> str:
    return f"{output.rstrip('/')}/manifest"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def new_folder(output: str) -> str:
    """A folder for one run's outputs that no reader knows yet."""
    return f"{output.rstrip('/')}/versions/{uuid.uuid4().hex}"


def history(spark: SparkSession, output: str) -> list[Version]:
    """The published versions, oldest first."""
    if not _exists(spark, _manifest(output)):
        return []
    rows = spark.read.schema(_SCHEMA).json(_manifest(output)).where("number is not null").collect()
    found = [Version(r.number, r.version, dict(r.outputs or {}), dict(r.notes or {})) for r in rows]
    return sorted(found, key=lambda v: (v.number, v.version))


def current(spark: SparkSession, output: str) -> Version | None:
    """What readers see; None before the first publication."""
    return next(reversed(history(spark, output)), None)


def publish(
    spark: SparkSession, output: str, folder: str, names: Iterable[str] = (),
    kept: dict[str, str] | None = None, notes: dict[str, str] | None = None,
) -> Version:
    """Make the outputs ``names`` below ``folder`` the current ones, with ``kept`` ones of
    earlier versions beside them. Fails, and changes nothing, if one of them is not complete."""
    outputs = {**(kept or {}), **{name: f"{folder}/{name}" for name in names}}
    for name, path in outputs.items():
        # a folder of a partitioned output is complete when the whole output is
        if not any(_exists(spark, f"{p}/_SUCCESS") for p in (path, path.rsplit("/", 1)[0])):
            raise ValueError(f"output {name} is not complete: {path}")
    last = current(spark, output)
    version = Version(last.number + 1 if last else 1, folder.rstrip("/").rsplit("/", 1)[-1], outputs, notes or {})
    line = spark.createDataFrame([(version.number, version.version, outputs, version.notes)], _SCHEMA)
    line.coalesce(1).write.mode("append").json(_manifest(output))
    return version


def read(spark: SparkSession, output: str, name: str, file_format: str = "parquet") -> DataFrame:
    """An output of the current version."""
    now = current(spark, output)
    if now is None or name not in now.outputs:
        raise ValueError(f"no published output {name} below {output}")
    return spark.read.format(file_format).load(now.outputs[name])


def _folder_of(output: str, path: str) -> str:
    """The run's folder that holds an output."""
    root = f"{output.rstrip('/')}/versions/"
    return root + path.removeprefix(root).split("/", 1)[0] if path.startswith(root) else ""


def expired(spark: SparkSession, output: str, keep: int = 2) -> list[str]:
    """Run folders that none of the last ``keep`` versions reads: what a clean-up may delete
    once readers that started before are done."""
    versions = history(spark, output)
    used = {_folder_of(output, path) for v in versions[-keep:] for path in v.outputs.values()}
    old = {_folder_of(output, path) for v in versions[:-keep] for path in v.outputs.values()}
    return sorted(old - used - {""})


def remove_expired(spark: SparkSession, output: str, keep: int = 2) -> list[str]:
    """Delete the :func:`expired` folders, all below ``<output>/versions``; returns them."""
    gone = expired(spark, output, keep)
    for folder in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return gone

