import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from caseloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """First column of an expression over one-column text rows."""

    def run(texts, make):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        from pyspark.sql import functions as F

        return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]

    return run
