"""D4, D5, F3, E3, E6 batch by batch: counts that are merged, so that a new batch of payments
costs a pass over that batch and not over history.

``apply`` counts one batch with the main pass (quality codes, row and table findings) and with
the keys of the group rules, merges both into the state below ``output`` and publishes it as one
version. The batch key makes it idempotent: a batch that was applied before changes nothing.
Counts only ever add up, so batches may come in any order and in any size.

The state of the main pass is as small as one run's: a row per group and combination of open code
families. The state of the group rules holds a row per key (payment id, customer), dealt into
``BUCKETS`` folders by a hash of the key; a batch rewrites the folders that its keys fall into,
the others are taken over from the version before. A key's finding appears in the version in
which its count reaches the rule's minimum.

A NULL group is a group like any other. Notes name the batches applied, one entry each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagoscope.functions import literal
from pagoscope.operators import findings as fd, quality, totals as tt
from pagoscope.operators.quality_rules import RULES
from pagoscope.sources import files, versions
from pagoscope.sources.layout import conform

BUCKETS = 32
COUNTS = "counts"
_BATCH = "batch"


def _bucket_name(bucket: int) -> str:
    return f"keys_{bucket:04d}"


def merged_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """Counts of the main pass added up by all their keys."""
    together = reduce(lambda a, b: a.unionByName(b), parts)
    measures = [f.name for f in together.schema if f.dataType.typeName() == "long" and _is_measure(f.name)]
    keys = [c for c in together.columns if c not in measures]
    return together.groupBy(*keys).agg(*[F.sum(f"`{m}`").alias(m) for m in measures]).select(*together.columns)


def _is_measure(name: str) -> bool:
    return name in quality.count_measures(RULES) or name in tt.hits(fd.FINDINGS)


def key_counts(payments: DataFrame, group_by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """(bucket, groups, rule_seq, key, n): the payments of each key of the group rules."""
    rules = fd.of_kind(fd.FINDINGS, fd.GroupFinding)
    keys = ", ".join(
        f"CASE WHEN {r.when} THEN named_struct('rule_seq', {r.seq}, 'key', CAST({r.key} AS STRING)) END" for r in rules
    )
    return (
        fd.parsed(payments).select(*group_by, F.expr(f"explode(array({keys}))").alias("_k"))
        .where("_k IS NOT NULL").select(*group_by, "_k.rule_seq", "_k.key")
        .groupBy(*group_by, "rule_seq", "key").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.expr(f"cast(pmod(xxhash64(rule_seq, key), {buckets}) as int)"))
    )


def applied(spark: SparkSession, output: str) -> list[str]:
    """Keys of the batches that the state holds."""
    return sorted(v.notes[_BATCH] for v in versions.history(spark, output))


def apply(
    spark: SparkSession, output: str, batch: str, payments: DataFrame, group_by: Sequence[str] = (),
    as_of=None, buckets: int = BUCKETS,
) -> versions.Version:
    """Add one batch of payments, known by its key, to the state; returns the current version."""
    before = versions.history(spark, output)
    now = before[-1] if before else None
    if any(v.notes[_BATCH] == batch for v in before):
        return now
    shape = {"group_by": ",".join(group_by), "buckets": str(buckets)}
    if now and any(now.notes[k] != v for k, v in shape.items()):
        raise ValueError(f"the state below {output} was built with {now.notes}")
    payments, folder = conform(payments), versions.new_folder(output)

    files.write_parquet(tt.main_counts(payments, group_by, as_of=as_of), f"{folder}/batch_counts")
    parts = [spark.read.parquet(f"{folder}/batch_counts")]
    if now:
        parts.append(spark.read.schema(parts[0].schema).parquet(now.outputs[COUNTS]))
    files.write_parquet(merged_counts(parts), f"{folder}/{COUNTS}")

    key_counts(payments, group_by, buckets).write.partitionBy("bucket").parquet(f"{folder}/batch_keys")
    shapes = T.StructType([f for f in key_counts(payments, group_by, buckets).schema if f.name != "bucket"])
    new = spark.read.schema(shapes.add("bucket", T.IntegerType())).parquet(f"{folder}/batch_keys")
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    kept = {k: v for k, v in now.outputs.items() if k != COUNTS} if now else {}
    old = [kept[_bucket_name(b)] for b in touched if _bucket_name(b) in kept]
    whole = new.drop("bucket")
    if old:
        whole = whole.unionByName(spark.read.schema(whole.schema).parquet(*old))
    keys = [*group_by, "rule_seq", "key"]
    summed = whole.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn(
        "bucket", F.expr(f"cast(pmod(xxhash64(rule_seq, key), {buckets}) as int)")
    )
    summed.write.partitionBy("bucket").parquet(f"{folder}/keys")
    kept |= {_bucket_name(b): f"{folder}/keys/bucket={b}" for b in touched}
    return versions.publish(spark, output, folder, [COUNTS], kept, {**shape, _BATCH: batch})


def _current(spark: SparkSession, output: str) -> tuple[versions.Version, list[str]]:
    now = versions.current(spark, output)
    if now is None:
        raise ValueError(f"no batch was applied below {output}")
    return now, [c for c in now.notes["group_by"].split(",") if c]


def counts(spark: SparkSession, output: str) -> DataFrame:
    """The main pass over all batches so far."""
    return spark.read.parquet(_current(spark, output)[0].outputs[COUNTS])


def failures(spark: SparkSession, output: str) -> DataFrame:
    """D4 over all batches so far."""
    return quality.failures_of(counts(spark, output), _current(spark, output)[1])


def summary(spark: SparkSession, output: str) -> DataFrame:
    """D5 over all batches so far."""
    group_by = _current(spark, output)[1]
    return quality.rolled_up(counts(spark, output), RULES, group_by).select(*group_by, *quality.SUMMARY_COLUMNS)


def group_findings(spark: SparkSession, output: str) -> DataFrame:
    """E3 and E6 over all batches so far."""
    now, group_by = _current(spark, output)
    keys = spark.read.parquet(*[path for name, path in now.outputs.items() if name != COUNTS])
    parts = []
    for rule in fd.of_kind(fd.FINDINGS, fd.GroupFinding):
        reached = keys.where((F.col("rule_seq") == rule.seq) & (F.col("n") >= rule.minimum)).withColumnsRenamed(
            {"key": rule.key, "n": "affected_records"}
        )
        parts.append(fd.of_counts(reached, rule, group_by))
    return reduce(DataFrame.unionByName, parts)


def totals(spark: SparkSession, output: str) -> DataFrame:
    """The run totals, which feed every score, over all batches so far."""
    return tt.totals_from(counts(spark, output), group_findings(spark, output), _current(spark, output)[1])


def risk_areas(spark: SparkSession, output: str) -> DataFrame:
    """F3 over all batches so far: affected records per risk area that has findings."""
    group_by = _current(spark, output)[1]
    areas = list(dict.fromkeys(r.risk_area for r in fd.FINDINGS))
    pairs = ", ".join(
        f"{literal(a)}, {tt.count_where(lambda r, a=a: r.risk_area == a)}, {tt.area_weight(a)}" for a in areas
    )
    return totals(spark, output).selectExpr(
        *group_by, f"stack({len(areas)}, {pairs}) AS (risk_area, found, affected)"
    ).where("found > 0").drop("found")
