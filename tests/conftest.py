import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).is_dir():
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def comparable(rows):
    """Rows as sorted tuples of text: floats to nine digits, null told apart."""
    return sorted(tuple("NULL" if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, small):
    def check(name, query, sql):
        df = query(spark, small)
        names = sorted(df.columns)
        got = [tuple(r) for r in df.select(*names).collect()]
        found = duck.execute(sql)
        order = [d[0] for d in found.description]
        assert sorted(order) == names, name
        want = [tuple(r[order.index(n)] for n in names) for r in found.fetchall()]
        assert comparable(got) == comparable(want), name

    return check
