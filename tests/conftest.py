import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lorebed.session import session

    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": "/tmp/lorebed-warehouse",
    }
    made = session("tests", "local[4]", **settings)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 9) if not math.isinf(x) else x
    return str(x)


@pytest.fixture(scope="session")
def same():
    """Compare a DataFrame with DuckDB rows, whatever the order."""

    def check(df, relation) -> int:
        ours, theirs = df.toPandas(), relation.df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        rows = [sorted((tuple(map(plain, r)) for r in t[sorted(t.columns)].itertuples(index=False)), key=repr) for t in (ours, theirs)]
        assert rows[0] == rows[1]
        return len(rows[0])

    return check
