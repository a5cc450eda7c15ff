import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowtrail.session import build_session  # noqa: E402

T0 = datetime(2022, 9, 1)
TRANSFER = (
    "from_node string, to_node string, amount_paid double, timestamp timestamp_ntz, payment_format string, "
    "payment_currency string, receiving_currency string, is_laundering int, ring_id bigint, pattern_type string"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        # Tiny inputs: compiling each stage would take longer than running it.
        **{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false",
           "spark.sql.adaptive.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def transfers(spark):
    """Build transfers from (from, to, amount, hours) tuples plus optional keywords."""

    def build(rows):
        full = []
        for row in rows:
            src, dst, amount, hours, *rest = row
            extra = rest[0] if rest else {}
            full.append(
                (
                    src,
                    dst,
                    float(amount),
                    T0 + timedelta(hours=hours),
                    extra.get("rail", "ACH"),
                    extra.get("cur", "Euro"),
                    extra.get("rcur", "Euro"),
                    extra.get("bad", 0),
                    extra.get("ring"),
                    extra.get("type"),
                )
            )
        return spark.createDataFrame(full, TRANSFER)

    return build
