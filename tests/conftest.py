import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleanmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.session.timeZone": "UTC",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def column(spark, values, kind="string"):
    """One-column frame v."""
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def evaluate(spark, values, *expressions):
    """Rows of the expressions over a string column v, in input order."""
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    named = [e.alias(f"f{n}") for n, e in enumerate(expressions)]
    rows = sorted(frame.select("i", *named).collect(), key=lambda r: r["i"])
    if len(expressions) == 1:
        return [r[1] for r in rows]
    return [tuple(r)[1:] for r in rows]
