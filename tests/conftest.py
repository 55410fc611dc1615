from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from barloom.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """Two symbols over 140 business days, prices from a fixed recurrence."""
    import datetime as dt

    rows = []
    for s, code in enumerate(("000001", "600519")):
        price, day = 10.0 + 50 * s, dt.date(2024, 1, 1)
        for i in range(140):
            move = ((i * 37 + s * 11) % 19 - 9) / 300.0
            opened, price = price, price * (1 + move)
            rows.append(
                (code, day, opened, max(opened, price) * 1.01, min(opened, price) * 0.99, price, 1000.0 + (i * 7) % 50, price * 1000)
            )
            day += dt.timedelta(days=3 if day.weekday() == 4 else 1)
    return spark.createDataFrame(
        rows, "code string, date date, open double, high double, low double, close double, volume double, amount double"
    )
