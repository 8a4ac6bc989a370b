import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lagweave.session import local_session

    s = local_session(4, "tests", "6g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


def plain(v):
    """Values of both engines in one form; doubles to nine digits."""
    if v is None or isinstance(v, (bool, int, str)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}" if math.isfinite(v) else str(v)
    return str(v)


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compares a query with its SQL on the smallest tables."""
    import glob
    from collections import Counter

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def compare(query, sql):
        df = query(spark, SMALL)
        cols = sorted(df.columns)
        cur = c.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = Counter(tuple(plain(r[names.index(k)]) for k in cols) for r in cur.fetchall())
        got = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
        assert got == want

    return compare
