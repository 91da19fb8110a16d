import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the Python workers
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def compare(spark, small):
    """Holds a query against its SQL: same columns, same rows in any order."""
    import duckdb

    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def plain(x):
        if isinstance(x, float):
            return "null" if x != x else repr(round(x, 5) + 0.0)
        return "null" if x is None else str(x)

    def check(query, sql):
        df = query(spark, small)
        wanted = con.sql(sql)
        assert sorted(df.columns) == sorted(wanted.columns)
        names = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
        index = {c: i for i, c in enumerate(wanted.columns)}
        assert got == sorted(tuple(plain(r[index[c]]) for c in names) for r in wanted.fetchall())

    return check
