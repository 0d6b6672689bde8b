import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, *tuples): a small table."""
    def make(schema, *tuples):
        return spark.createDataFrame(list(tuples), schema)
    return make


