import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))  # the repository
from inkframe.session import local_session

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def data():
    return DATA


def canonical(frame):
    """Rows as sorted tuples of comparable values, columns by name."""
    import numpy as np
    import pandas as pd

    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return str([plain(x) for x in v])
        if v is None or v is pd.NA or v != v:
            return "None"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)):
            return str(int(v))
        if isinstance(v, (float, np.floating)):
            return str(int(v)) if v == int(v) else repr(round(float(v), 9))
        return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(spark_frame, duck_frame):
        a, b = canonical(spark_frame.toPandas()), canonical(duck_frame.df())
        assert a[0] == b[0]
        assert len(a[1]) == len(b[1])
        wrong = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
        assert not wrong, wrong[:3]

    return check
