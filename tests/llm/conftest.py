import pytest

from tests.llm import fixtures


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(fixtures.rows(), fixtures.SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], fixtures.SCHEMA)
