import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir):
    """Checks that a query gives the rows of its SQL."""
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")

    def norm(rows, names):
        order = sorted(range(len(names)), key=lambda k: names[k])
        text = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
        return sorted(tuple(text(r[k]) for k in order) for r in rows)

    def check(query, sql):
        got = query(spark, sf_dir)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        assert norm([tuple(r) for r in got.collect()], got.columns) == norm(want.fetchall(), names)

    return check
