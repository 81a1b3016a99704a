import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session  # noqa: E402


# Started here, because test modules build column expressions when they are imported.
SPARK = local_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture
def table(spark):
    """Rows and a schema text to a DataFrame."""

    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)
