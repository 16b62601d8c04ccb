import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    held = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        place = f"{TINY}/{table}.parquet"
        held.execute(f"CREATE VIEW {table} AS SELECT * FROM '{place if os.path.isfile(place) else place + '/*.parquet'}'")
    return held


@pytest.fixture(scope="session")
def same_rows(duck):
    """Whether a DataFrame and the SQL have the same columns and rows."""
    from collections import Counter

    def even(value):
        return round(value, 6) if isinstance(value, float) else value

    def check(frame, sql: str) -> None:
        names = sorted(frame.columns)
        rows = Counter(tuple(even(r[c]) for c in names) for r in frame.collect())
        found = duck.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        assert rows == Counter(tuple(even(r[k]) for k in at) for r in found.fetchall())

    return check
