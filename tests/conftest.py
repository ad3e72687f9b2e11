import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from guardrag.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", shuffle_partitions=8, app="guardrag-tests")
    yield s


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def evaluate(spark, column_fn, *values, schema="t string"):
    """Evaluate a column expression over a one-column DataFrame; returns a list of results."""
    df = spark.createDataFrame([(v,) for v in values], schema)
    name = schema.split()[0]
    return [r[0] for r in df.select(column_fn(name).alias("out")).collect()]
