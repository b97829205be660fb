import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillmark.operators.enrich import enrich  # noqa: E402
from tillmark.schema import TRANSACTION_COLUMNS  # noqa: E402
from tillmark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SF


@pytest.fixture(scope="session")
def sell(spark):
    """Enriched transactions from ``(time, qty, price, store, category)``."""

    def make(rows):
        data = [
            (str(i), time, float(qty), float(price), store, category, "any")
            for i, (time, qty, price, store, category) in enumerate(rows)
        ]
        schema = ", ".join(
            f"{c} {'double' if c in ('transaction_qty', 'unit_price') else 'string'}" for c in TRANSACTION_COLUMNS
        )
        df = spark.createDataFrame(data, schema)
        return enrich(df.withColumn("transaction_time", df.transaction_time.cast("timestamp")))

    return make
