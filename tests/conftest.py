import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from chronoloom.session import build_session

    s = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Builds a (key, date, y) frame from {key: [(day offset, value), ...]}."""
    import datetime

    def make(data, start=datetime.date(2020, 1, 6), step=1):
        rows = [(k, start + datetime.timedelta(days=step * i), None if v is None else float(v))
                for k, points in data.items() for i, v in points]
        return spark.createDataFrame(rows, "key string, date date, y double")

    return make


def by_key(df, *cols, order="date"):
    """{key: [values or tuples in order]}."""
    out = {}
    for r in df.orderBy("key", order).collect():
        out.setdefault(r["key"], []).append(r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols))
    return out
