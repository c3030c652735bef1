import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same_rows(df, con, sql):
    """A Spark result and DuckDB's, columns by name, rows in any order; doubles may differ in the last rounded digit."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    value = lambda v: float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    order = lambda rows: sorted((tuple(value(r[i]) for i in at) for r, at in rows), key=lambda r: tuple((x is None, type(x).__name__, round(x, 4) if isinstance(x, float) else x) for x in r))
    a = order([(tuple(r), [df.columns.index(k) for k in key]) for r in df.collect()])
    b = order([(r, [names.index(k) for k in key]) for r in found.fetchall()])
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or isinstance(p, float) and abs(p - q) <= 2e-4 * max(1e-3, abs(q)), (x, y)
