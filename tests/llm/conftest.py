import os

import pytest

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="session")
def make(spark):
    """Rows as a frame whose columns clash with nothing the operators may drop."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def small(data):
    return data if os.path.isdir(data) else pytest.skip("driver tables are not here")
