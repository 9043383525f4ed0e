import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def oracle(sf_dir):
    import duckdb

    db = duckdb.connect()
    for name in "documents pages benchmark labels conversations events".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")

    def run(sql):
        q = db.execute(sql)
        names = [x[0] for x in q.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return [names[i] for i in order], sorted([str(r[i]) for i in order] for r in q.fetchall())

    return run


@pytest.fixture(scope="session")
def rows_of():
    def rows(df):
        names = sorted(df.columns)
        return names, sorted([str(x) for x in r] for r in df.select(*names).collect())

    return rows
