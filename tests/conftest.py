"""A session for all tests, and a comparison with SQL over the same tables."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    return round(float(value), 9) if isinstance(value, (int, float)) else value


@pytest.fixture
def same_as_sql():
    def check(df, sql: str, folder: str = SF):
        import duckdb

        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        names = sorted(df.columns)
        result = con.sql(sql)
        assert sorted(result.columns) == names
        ours = sorted(str([_plain(v) for v in (r[n] for n in names)]) for r in df.collect())
        at = [result.columns.index(n) for n in names]
        theirs = sorted(str([_plain(r[i]) for i in at]) for r in result.fetchall())
        assert ours == theirs

    return check
