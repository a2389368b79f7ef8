import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pricelab.session import local_session

    s = local_session("*", app="pricelab-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


def bars_df(spark, series: dict[str, list[float]], start: str = "2024-01-01", skip_weekends: bool = False):
    """Hand-made bars: one row per close, consecutive days from ``start``."""
    import datetime as dt

    rows = []
    d0 = dt.date.fromisoformat(start)
    for t, closes in series.items():
        d = d0
        for c in closes:
            while skip_weekends and d.weekday() >= 5:
                d += dt.timedelta(days=1)
            rows.append((t, d, c, c, c, c, 1.0))
            d += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, "
                                       "close double, volume double")
