import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from checks.verify import session

    return session("4")


@pytest.fixture
def source(spark):
    """Files from (path, text) pairs or (repo, path, text) triples; language and surface follow."""
    from pyspark.sql import functions as F

    from codetrawl.functions import paths

    def make(*rows):
        full = [("r", *row) if len(row) == 2 else row for row in rows]
        frame = spark.createDataFrame(full, "repo string, path string, text string")
        return frame.select(
            "repo", "path", paths.language_of(F.col("path")).alias("language"), "text",
            F.octet_length("text").cast("long").alias("size"), paths.surface_of(F.col("path")).alias("code_surface"))

    return make
