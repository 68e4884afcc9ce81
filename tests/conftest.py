import os
import sys
from pathlib import Path

import pytest

TESTS = Path(__file__).resolve().parent
sys.path.insert(0, str(TESTS.parent))
# the Python workers need the package and the tests' own classes
os.environ["PYTHONPATH"] = os.pathsep.join([str(TESTS.parent), str(TESTS), os.environ.get("PYTHONPATH", "")])
DATA = Path(os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import local_session

    session = local_session(8, "4g", 2, spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.is_dir():
        pytest.skip("no test tables")
    return str(DATA)


@pytest.fixture(scope="session")
def sql(data):
    """Runs SQL over the test tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same_rows(df, con, query):
    """Whether a DataFrame and a SQL text give the same columns and rows, in any order."""
    columns = sorted(df.columns)
    assert sorted(con.sql(query).columns) == columns
    left = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    right = sorted(repr(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({query})").fetchall())
    assert left == right
    return len(left)
