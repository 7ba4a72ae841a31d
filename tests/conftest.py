from __future__ import annotations

import pytest

from fareloom import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FIELDS = ("observation_id", "airline", "origin", "destination", "flight_date", "booking_date", "total_fare", "currency")


def quote_rows(spark, rows, extra: str = ""):
    """Rows of the eight required columns, plus `extra` columns given as a schema text."""
    schema = ", ".join(f"{f} {'double' if f == 'total_fare' else 'string'}" for f in FIELDS)
    return spark.createDataFrame(rows, schema + (", " + extra if extra else ""))


def month_quotes(route: str, period: str, fares, tag: str = ""):
    origin, destination = route.split("-")
    return [
        (f"{route}{period}{tag}{i}", "IndiGo", origin, destination, f"{period}-15", f"{period}-01", float(f), "INR")
        for i, f in enumerate(fares)
    ]
