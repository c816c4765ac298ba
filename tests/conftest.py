import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventlink.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def table(spark):
    """Rows of text as a DataFrame, converted by a DDL schema."""

    def make(schema: str, *rows):
        names = [part.split()[0] for part in schema.split(",")]
        kinds = [part.split()[1] for part in schema.split(",")]
        raw = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" for n in names))
        return raw.selectExpr(*[f"cast({n} as {k}) as {n}" for n, k in zip(names, kinds, strict=True)])

    return make


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]
