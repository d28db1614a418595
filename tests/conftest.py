import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tenura.session import build_session

    session = build_session(
        app="tests",
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="warehouse-"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="shared-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def make_customers(spark):
    """Customers from partial dicts; everything not given has a valid default."""
    from tenura import schema as S

    base = {
        "gender": "Male",
        "senior_citizen": 0,
        "partner": "No",
        "dependents": "No",
        "tenure": 10,
        "internet_service": "DSL",
        "contract": "Month-to-month",
        "paperless_billing": "No",
        "payment_method": "Mailed check",
        "monthly_charges": 50.0,
        "total_charges": 500.0,
        "churn": "No",
    } | {s: "No" for s in S.SERVICES}

    def build(*rows):
        full = [{"customer_id": str(i)} | base | r for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in S.COLUMN_TYPES) for r in full], S.customers_schema())

    return build
