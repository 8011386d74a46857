import os
import signal
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Seconds that one test may take.
MOST_SECONDS = 240


@pytest.fixture(autouse=True)
def limit():
    """A test that never ends fails instead of stopping the others."""

    def late(*_):
        raise TimeoutError(f"the test took over {MOST_SECONDS} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(MOST_SECONDS)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same_rows(df, duck, sql):
    """Whether a DataFrame and a query have the same columns and the same bag of rows."""
    from collections import Counter

    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]

    def norm(x):
        return float(x) if isinstance(x, float) else x

    left = Counter(tuple(map(norm, r)) for r in df.collect())
    right = Counter(tuple(norm(r[k]) for k in at) for r in found.fetchall())
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])
