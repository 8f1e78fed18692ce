import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from paperlode.session import local_session

    session = local_session("tests", cores="8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of one expression over one row of named values."""

    def run(expression, schema: str, *values):
        return spark.createDataFrame([values], schema).select(expression.alias("x")).first()["x"]

    return run
