"""A deterministic payments table derived from ``orders`` and ``customer``.

Every order becomes one payment; defects are injected by residues of the order
key, so any engine that reads the same two tables sees the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagoscope.sources.layout import PAYMENT_COLUMNS, ROW_ID, conform

_DATE = "date_format({}, 'yyyy-MM-dd HH:mm:ss')"

_EXPRESSIONS = {
    "payment_id": """
        CASE WHEN k % 211 = 0 THEN NULL
             WHEN k % 223 = 5 THEN '   '
             WHEN k % 97 = 2 THEN 'PAY-' || lpad(cast(k - 1 AS string), 8, '0')
             ELSE 'PAY-' || lpad(cast(k AS string), 8, '0') END""",
    "customer_name": "CASE WHEN k % 61 = 3 THEN NULL ELSE c_name END",
    "customer_email": """
        CASE WHEN k % 122 = 3 OR k % 31 = 4 THEN NULL
             WHEN k % 37 = 5 THEN 'not-an-email'
             WHEN k % 41 = 6 THEN 'missing@'
             ELSE lower(replace(c_name, '#', '.')) || '@bank.example' END""",
    "amount": """
        CASE WHEN k % 53 = 7 THEN NULL
             WHEN k % 103 = 10 THEN '   '
             WHEN k % 101 = 9 THEN 'N/D'
             WHEN k % 59 = 8
               THEN '-' || cast(cast(floor(o_totalprice) AS bigint) % 5000 + 1 AS string)
             WHEN k % 107 = 11 THEN cast(999000 + (k % 3) * 600000 AS string)
             WHEN o_custkey % 10 = 0 AND k % 3 = 0 THEN cast(9000 + k % 1000 AS string)
             ELSE cast(cast(floor(o_totalprice) AS bigint) % 45000 AS string) END""",
    "currency_code": """
        CASE WHEN k % 20 < 10 THEN 'USD'
             WHEN k % 20 < 14 THEN 'EUR'
             WHEN k % 20 < 16 THEN 'COP'
             WHEN k % 20 = 16 THEN 'GBP'
             WHEN k % 20 = 17 THEN 'MXN'
             WHEN k % 40 = 18 THEN 'XXX'
             WHEN k % 40 = 38 THEN NULL
             WHEN k % 60 = 19 THEN 'IRR'
             WHEN k % 60 = 39 THEN 'JPY'
             ELSE 'usd' END""",
    "status": """
        CASE WHEN k % 43 = 0 THEN NULL
             WHEN k % 47 = 1 THEN 'UNKNOWN'
             WHEN k % 71 = 2 THEN 'ON_HOLD'
             WHEN k % 73 = 3 THEN ' completed '
             WHEN o_orderstatus = 'F' THEN 'COMPLETED'
             WHEN o_orderstatus = 'O' THEN 'PENDING'
             ELSE 'PROCESSING' END""",
    "country_code": """
        CASE c_nationkey WHEN 0 THEN 'US' WHEN 1 THEN 'CO' WHEN 2 THEN 'MX'
             WHEN 3 THEN 'ES' WHEN 4 THEN 'GB' WHEN 5 THEN 'DE' WHEN 6 THEN 'FR'
             WHEN 7 THEN 'BR' WHEN 8 THEN 'AR' WHEN 9 THEN 'CL' WHEN 10 THEN 'PE'
             WHEN 11 THEN 'IR' WHEN 12 THEN 'VE' WHEN 13 THEN 'ZZ' WHEN 14 THEN NULL
             WHEN 15 THEN 'co'
             WHEN 16 THEN 'SD' ELSE 'US' END""",
    "created_at": f"""
        CASE WHEN k % 67 = 1 THEN NULL
             WHEN k % 79 = 2 THEN '2999-01-01 00:00:00'
             WHEN k % 83 = 3 THEN 'not-a-date'
             WHEN k % 101 = 4 THEN 'T12:30:00'
             WHEN k % 103 = 5 THEN date_format(o_orderdate, 'yyyy/MM/dd HH:mm:ss')
             WHEN k % 107 = 6 THEN date_format(o_orderdate, 'dd-MM-yyyy HH:mm:ss')
             ELSE {_DATE.format('o_orderdate')} END""",
    "updated_at": f"""
        CASE WHEN k % 113 = 1 THEN NULL
             WHEN k % 89 = 4 THEN {_DATE.format('o_orderdate - INTERVAL 1 DAY')}
             ELSE {_DATE.format('o_orderdate')} END""",
    "source_system": """
        CASE WHEN k % 91 = 0 THEN NULL
             WHEN k % 5 = 0 THEN 'CORE_BANKING'
             WHEN k % 5 = 1 THEN 'SWIFT'
             WHEN k % 5 = 2 THEN 'ACH'
             WHEN k % 5 = 3 THEN 'SEPA'
             ELSE 'LEGACY_COBOL' END""",
    "sanction_flag_expected": "CASE WHEN c_nationkey IN (11, 12) THEN '1' ELSE '0' END",
}


def payments_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One payment per order; the join side sizes are left to the optimizer."""
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn(
        "k", F.col("o_orderkey")
    )
    derived = joined.select(
        F.col("k").alias(ROW_ID),
        *[F.expr(text).alias(name) for name, text in _EXPRESSIONS.items()],
    )
    return conform(derived).select(ROW_ID, *PAYMENT_COLUMNS)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments view over a directory of the given parquet tables."""
    return payments_from_orders(
        spark.read.parquet(f"{sf_dir}/orders.parquet"),
        spark.read.parquet(f"{sf_dir}/customer.parquet"),
    )
