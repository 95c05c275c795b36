"""The whole assessment: payments in; zones, counts, findings, scores, advice out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagoscope.operators import advisor, findings as fd, quality, scores
from pagoscope.operators import totals as tt
from pagoscope.sources import catalog, files, versions, zones
from pagoscope.sources.layout import conform


OUTPUTS = (
    "zones", "counts", "group_findings", "failures", "rule_detail", "snapshot", "readiness",
    "readiness_texts", "totals", "findings", "frameworks", "scores", "advice",
)


@dataclass(frozen=True)
class Assessment:
    """Lazy results; nothing runs until one of them is used."""

    evaluated: DataFrame
    findings: DataFrame
    totals: DataFrame
    scored: DataFrame
    advice: DataFrame


def assess(
    payments: DataFrame, group_by: Sequence[str] = (), posture=None, as_of=None
) -> Assessment:
    """Declare every result over one payments table."""
    payments = conform(payments)
    totals = tt.run_totals(payments, group_by, as_of=as_of)
    scored = scores.regulatory_scores(quality.readiness(totals, posture)).withColumn(
        "findings", F.expr(tt.total_findings())
    )
    advice = advisor.with_costs(advisor.with_risk_class(advisor.decide(scored)))
    return Assessment(
        evaluated=quality.evaluate(payments, as_of=as_of),
        findings=fd.findings(payments, group_by),
        totals=totals,
        scored=scored,
        advice=advice,
    )


def run(
    spark: SparkSession,
    payments: DataFrame,
    output: str,
    group_by: Sequence[str] = (),
    posture=None,
    as_of=None,
    system: str = "payments",
) -> dict[str, str]:
    """Write every output below ``output`` and return their paths.

    The outputs are written into a folder of their own and published together at the end
    (``versions``): readers of :func:`current` see all of a run or nothing of it.

    The zones are written first, from one evaluation. They are read back three times: for
    the counts of the main pass, for the keys of the group rules, and for the row findings.
    Everything else (failures, detail, snapshot, readiness, totals, table findings, scores,
    advice) folds those small written counts. A lost executor never sends a stage back to
    the source.

    ``scores`` is the report header, ``frameworks`` the view per framework, ``findings`` the
    long table. ``register`` then makes catalog tables of the outputs where wanted.
    """
    folder = versions.new_folder(output)
    at = {name: f"{folder}/{name}" for name in OUTPUTS}
    zones.write_zones(quality.evaluate(conform(payments), as_of=as_of), at["zones"])
    routed = zones.read_zones(spark, at["zones"]).drop(zones.ZONE, "dq_errors")

    def kept(name: str, rows: DataFrame) -> DataFrame:
        files.write_parquet(rows, at[name])
        return spark.read.schema(rows.schema).parquet(at[name])

    counts = kept("counts", tt.main_counts(routed, group_by, as_of=as_of))
    groups = kept("group_findings", fd.group_findings(routed, group_by))

    failures = kept("failures", quality.failures_of(counts, group_by))
    files.write_parquet(quality.detail_of(failures, group_by), at["rule_detail"])
    totals = kept("totals", tt.totals_from(counts, groups, group_by))
    ready = quality.readiness(totals, posture)
    files.write_parquet(totals.select(*group_by, *quality.SUMMARY_COLUMNS), at["snapshot"])
    files.write_json_document(
        ready.select(*group_by, *quality.READINESS_COLUMNS), at["readiness"]
    )
    files.write_parquet(quality.readiness_texts(ready, group_by), at["readiness_texts"])

    tables = fd.table_findings(tt.folded_counts(counts, group_by), group_by=group_by)
    files.write_parquet(
        fd.row_findings(routed, group_by).unionByName(groups).unionByName(tables), at["findings"]
    )
    files.write_parquet(scores.findings_by_framework(totals, group_by), at["frameworks"])
    scored = scores.regulatory_scores(ready).withColumn("findings", F.expr(tt.total_findings()))
    files.write_json_document(
        scores.score_document(scored, group_by, system, as_of), at["scores"]
    )
    advice = advisor.with_costs(advisor.with_risk_class(advisor.decide(scored)))
    files.write_json_document(advice, at["advice"])
    return versions.publish(spark, output, folder, OUTPUTS).outputs


def current(spark: SparkSession, output: str) -> dict[str, str]:
    """Paths of the outputs of the last complete run."""
    version = versions.current(spark, output)
    if version is None:
        raise ValueError(f"no complete run below {output}")
    return version.outputs


TABLES = ("rule_detail", "snapshot", "findings", "frameworks", "failures")


def register(spark: SparkSession, at: dict[str, str], database: str) -> None:
    """Make catalog tables of the Parquet outputs of :func:`run`, replacing earlier ones."""
    catalog.create_database(spark, database)
    catalog.drop_tables(spark, database, TABLES)
    for name in TABLES:
        catalog.create_parquet_table(spark, f"{database}.{name}", at[name])
