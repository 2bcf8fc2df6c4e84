import public_tokenizers
import pytest
from pyspark.sql import functions as F

#: Extra columns whose names clash with those that operators use inside.
CLASHING = ("n", "key", "norm", "row", "file", "digest", "single", "bucket", "block", "component", "label", "rank", "shard", "_base")


@pytest.fixture(scope="session")
def clash():
    """Adds the clashing columns to a table."""
    def add(df):
        for c in CLASHING:
            df = df.withColumn(c, F.lit("x"))
        return df
    return add


@pytest.fixture(scope="session")
def place():
    return public_tokenizers.path
