import glob
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cardloom.session import build_session

    session = build_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return repr(round(value, 6))
    if hasattr(value, "isoformat"):
        return value.isoformat().split("+")[0].removesuffix("T00:00:00")
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def same(df, con, sql: str) -> None:
    """Both results have the same columns and rows, in any order."""
    rows, cursor = df.collect(), con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cursor.fetchall())
    assert ours == theirs
