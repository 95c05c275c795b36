"""The payments layout: 21 text columns, their source names, and conforming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Payments column -> column of the system of record.
SOURCE_COLUMNS = {
    "payment_id": "payment_id",
    "customer_name": "full_name",
    "customer_email": "email",
    "amount": "amount",
    "currency_code": "currency_code",
    "status": "status_code",
    "country_code": "origin_country",
    "created_at": "created_at",
    "updated_at": "created_at",
    "source_system": "source_system",
    "sanction_flag_expected": "sanction_flag_expected",
    "duplicate_group_id": "duplicate_group_id",
    "structuring_cluster_id": "structuring_cluster_id",
    "swift_bic": "swift_bic",
    "iban": "iban",
    "beneficiary_country": "beneficiary_country",
    "beneficiary_name": "beneficiary_name",
    "masked_card": "masked_card",
    "source_dq_score": "data_quality_score",
    "source_quality_note": "source_quality_note",
    "raw_reference": "raw_reference",
}

PAYMENT_COLUMNS = tuple(SOURCE_COLUMNS)
ROW_ID = "row_id"
ERRORS_COLUMN = "dq_errors"

# The tokens a pandas CSV reader turns into null by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def payments_schema(extra: tuple[str, ...] = ()) -> T.StructType:
    """All-text schema of a payments file; never inferred."""
    return T.StructType(
        [T.StructField(name, T.StringType(), True) for name in PAYMENT_COLUMNS + extra]
    )


def rename_source(source: DataFrame) -> DataFrame:
    """A1: project the system-of-record columns onto the payments layout.

    Source columns that are absent become typed NULLs; ``row_id`` is kept when
    the source carries one.
    """
    present = set(source.columns)
    projected: list[Column] = [F.col(ROW_ID)] if ROW_ID in present else []
    for target, origin in SOURCE_COLUMNS.items():
        value = F.col(origin) if origin in present else F.lit(None)
        projected.append(value.cast("string").alias(target))
    return source.select(*projected)


def conform(payments: DataFrame) -> DataFrame:
    """Add the layout's missing columns as NULL text; keep any extra columns."""
    present = set(payments.columns)
    missing = {
        name: F.lit(None).cast("string") for name in PAYMENT_COLUMNS if name not in present
    }
    return payments.withColumns(missing) if missing else payments


def keyed(payments: DataFrame) -> DataFrame:
    """The payments with a ``row_id`` column: NULL where the source has no row key."""
    if ROW_ID in payments.columns:
        return payments
    return payments.withColumn(ROW_ID, F.lit(None).cast("bigint"))


def blank_tokens_to_null(payments: DataFrame, na_tokens: tuple[str, ...] = ("",)) -> DataFrame:
    """Turn the given tokens into NULL in every text column of the layout."""
    tokens = list(na_tokens)
    if not tokens:
        return payments
    return payments.withColumns(
        {
            name: F.when(~F.col(name).isin(tokens), F.col(name))
            for name in payments.columns
            if name in SOURCE_COLUMNS
        }
    )
