import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import session

    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the rows, columns and types of a SQL result, in any order."""
    import datetime

    import numpy as np
    import pandas as pd

    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]"}

    def plain(x):
        if isinstance(x, (np.ndarray, list)):
            return tuple(plain(y) for y in x)
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        if isinstance(x, datetime.date):
            return pd.Timestamp(x).isoformat()
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 6) if isinstance(x, float) else x

    def rows(p):
        return sorted((tuple(plain(v) for v in r) for r in p[sorted(p.columns)].values.tolist()), key=repr)

    def check(df, sql):
        types = {r[0]: r[1] for r in duck.sql(f"DESCRIBE {sql}").fetchall()}
        assert {k: kinds.get(t, t) for k, t in df.dtypes} == types
        assert rows(df.toPandas()) == rows(duck.sql(sql).df())

    return check
