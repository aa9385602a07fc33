import os
import sys

import pytest

for _x in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_x, "1")  # one BLAS thread a task: tasks fill the cores

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def same():
    """Compares two pandas tables as sorted rows of plain values."""
    import pandas as pd

    def plain(v):
        if hasattr(v, "item") and not isinstance(v, str):
            v = v.item() if getattr(v, "ndim", 0) == 0 else tuple(v.tolist())
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
            return int(v)
        return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "year") else v

    def rows(df):
        return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        x, y = rows(a), rows(b)
        assert len(x) == len(y)
        assert x == y, next((p, q) for p, q in zip(x, y, strict=True) if p != q)

    return check
