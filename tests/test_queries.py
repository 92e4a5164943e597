import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))
SF = "/root/testdata/sf0.001"

import __spark_entry__ as entry  # noqa: E402

from hyposcape.queries import ORACLE  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from check_oracle import TABLES

    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    from check_oracle import rows_of

    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), [d[0] for d in cur.description])


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
