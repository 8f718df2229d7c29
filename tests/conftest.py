import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quarrylens.session import local_session

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF_SMALL = "/root/testdata/sf0.001"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """A function that runs SQL on the tables of a folder and returns rows."""
    import duckdb

    def run(sql: str, folder: str = SF):
        c = duckdb.connect()
        c.execute("SET TimeZone='UTC'")
        for f in Path(folder).glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        return c.sql(sql).df()

    return run
