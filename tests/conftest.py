import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("STRATA_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def connect(d):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return db


def norm(x):
    if isinstance(x, bool) or x is None or isinstance(x, int):
        return x
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6)
    return str(x)


def same_rows(df, db, sql):
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    r = db.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(norm(row[i]) for i in order) for row in r.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert got == want
