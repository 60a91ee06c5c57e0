import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("RECONLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reconloom.session import local_session

    s = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


def plain(v):
    import numpy as np
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):  # pandas makes floats of integers beside nulls
        return int(v) if float(v).is_integer() else float(v)
    return str(v)


@pytest.fixture(scope="session")
def same_rows(spark, data, duck):
    """Whether a query and its SQL give the same columns and rows."""

    def check(f, sql):
        a, b = f(spark, data).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = lambda df: sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).values.tolist())
        assert rows(a) == rows(b)

    return check
