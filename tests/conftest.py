import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    session = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compares a DataFrame with a DuckDB query: columns by name, rows in any order."""

    def compare(frame, sql):
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(frame.columns) == sorted(names)
        mine = sorted((tuple(r[c] for c in sorted(names)) for r in frame.collect()), key=repr)
        at = [names.index(c) for c in sorted(names)]
        theirs = sorted((tuple(r[k] for k in at) for r in cursor.fetchall()), key=repr)
        assert mine == theirs
        return mine

    return compare
