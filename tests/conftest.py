import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import SMALL  # noqa: E402
from pagoscope.session import local_session  # noqa: E402
from pagoscope.sources import sample  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def payments(spark):
    return sample.payments(spark, SMALL).cache()


NEUTRAL = {
    "payment_id": "PAY-1", "customer_name": "A B", "customer_email": "a@b.co", "amount": "10",
    "currency_code": "USD", "status": "COMPLETED", "country_code": "US",
    "created_at": "2024-01-01 00:00:00", "updated_at": "2024-01-01 00:00:00",
    "source_system": "SWIFT",
}


@pytest.fixture(scope="session")
def table(spark):
    """Build a payments table from changes to a valid row."""

    def build(*changes: dict):
        schema = "row_id BIGINT, " + ", ".join(f"{name} STRING" for name in NEUTRAL)
        rows = [(i, *{**NEUTRAL, **change}.values()) for i, change in enumerate(changes, 1)]
        return spark.createDataFrame(rows, schema)

    return build
