from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallygrid.schemas import COUNTY_DIM, COUNTY_EVENTS, COUNTY_MART  # noqa: E402
from tallygrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def county_dim(spark):
    rows = [
        ("01001", "Autauga", "Alabama"),
        ("01003", "Baldwin", "Alabama"),
        ("48201", "Harris", "Texas"),
        ("12086", "Miami Dade", "Florida"),
        ("21097", "Harrison", "Kentucky"),
        ("48203", "Harrison", "Texas"),
    ]
    return spark.createDataFrame(rows, COUNTY_DIM)


@pytest.fixture(scope="session")
def county_mart(spark):
    """Six counties over 2019-2022; 12086 has no score, 21097 lacks the late years."""
    loss = {"01001": 40.0, "01003": 60.0, "48201": 99.5, "12086": None, "21097": 10.0,
            "48203": 60.0}
    base = {"01001": 5, "01003": 10, "48201": 20, "12086": 8, "21097": 1, "48203": 2}
    rows = []
    for fips, score in loss.items():
        for i, year in enumerate(range(2019, 2023)):
            if fips == "21097" and year > 2020:
                continue
            n = base[fips] + i * (3 if fips == "48201" else 1)
            rows.append(
                (fips, year, n, i, float(n), n // 2, n * 100.0, n, n * 1.0, n * 2.0, n * 3.0,
                 n * 4.0, n, score, score, score, score, 1000.0 * n, 50_000.0, 90_000.0,
                 100.0 * n, 5.0 * n, 200.0 * n, 40.0, 20.0, 10.0)
            )
    return spark.createDataFrame(rows, COUNTY_MART)


@pytest.fixture(scope="session")
def county_events(spark):
    rows = [
        ("01001", "Flood", 2019, 5, 1, 0, 10.0),
        ("01001", "Flood", 2021, 9, 0, 2, 20.0),
        ("01001", "Heat", 2020, 2, 3, 0, None),
        ("01001", "Excessive Heat", 2020, 4, 0, 0, 1.0),
        ("01003", "Flood", 2019, 7, 0, 0, 5.0),
        ("01003", "Flood", 2022, 6, 0, 0, None),
        ("48201", "Flood", 2019, 1, 0, 0, 2.0),
        ("48201", "Flood", 2020, 1, 0, 0, 2.0),
        ("48201", "Flood", 2022, 12, 4, 4, 3.0),
        ("48201", "Tornado", 2022, 3, 0, 1, 7.0),
        ("48203", "Flash Flood", 2022, 3, 0, 0, 8.0),
    ]
    return spark.createDataFrame(rows, COUNTY_EVENTS)


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
