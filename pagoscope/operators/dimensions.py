"""Constant lookup tables as DataFrames; all have a fixed size under 100 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagoscope import fixed_values as fv
from pagoscope.functions import literal


def table(spark: SparkSession, rows, *columns: str) -> DataFrame:
    """A local relation, which the optimizer folds or broadcasts, marked as small."""
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    frame = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
    return F.broadcast(frame)


def strategies(spark: SparkSession) -> DataFrame:
    return table(
        spark, fv.STRATEGIES,
        "strategy", "effort_weeks", "risk_level", "cloud_monthly", "reject_reason",
    )


def role_shares(spark: SparkSession) -> DataFrame:
    return table(spark, fv.ROLE_SHARES, "strategy", "role", "share")


def role_rates(spark: SparkSession) -> DataFrame:
    return table(spark, fv.ROLE_RATES, "role", "usd_per_hour")


def teams(spark: SparkSession) -> DataFrame:
    return table(spark, fv.TEAMS, "strategy", "ord", "role", "dedication", "headcount")


def team_rates(spark: SparkSession) -> DataFrame:
    return table(spark, fv.TEAM_RATES, "role", "usd_per_hour")


def phases(spark: SparkSession) -> DataFrame:
    rows = [
        (strategy, phase, name, weeks, place, action)
        for strategy, phase, name, weeks, actions in fv.PHASES
        for place, action in enumerate(actions, 1)
    ]
    listed = table(spark, rows, "strategy", "phase", "name", "weeks", "place", "action")
    in_order = F.array_sort(F.collect_list(F.struct("place", "action")))
    return F.broadcast(
        listed.groupBy("strategy", "phase", "name", "weeks")
        .agg(F.array_join(in_order.getField("action"), " | ").alias("actions"))
    )


def services(spark: SparkSession) -> DataFrame:
    return table(spark, fv.SERVICES, "strategy", "ord", "service")


def service_categories(spark: SparkSession) -> DataFrame:
    return table(spark, fv.SERVICE_CATEGORIES, "service", "category")


def category_layers(spark: SparkSession) -> DataFrame:
    return table(spark, fv.CATEGORY_LAYERS, "category", "layer")


def risks(spark: SparkSession) -> DataFrame:
    return table(
        spark, fv.RISKS, "strategy", "ord", "risk", "probability", "impact", "mitigation"
    )


def milestones(spark: SparkSession) -> DataFrame:
    return table(spark, fv.MILESTONES, "strategy", "week", "milestone")

