import pathlib

import pytest


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    """Python workers import the package from the repository, wherever pytest was started."""
    spark.sparkContext.environment["PYTHONPATH"] = str(pathlib.Path(__file__).resolve().parents[2])
