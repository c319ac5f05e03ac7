import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillon.session import create_session

    session = create_session("local[4]", "tests", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """The value of a column expression over one row of named columns."""
    from pyspark.sql import functions as F

    def of(build, **columns):
        row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in columns.items()])
        return row.select(build(*[F.col(k) for k in columns]).alias("x")).first()["x"]

    return of
