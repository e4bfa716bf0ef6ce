"""Every query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks import all_queries
from checks.compare import canonical, connect

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in TWINS:
        assert got
        return
    cur = con.execute(TWINS[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, got) == canonical(columns, cur.fetchall())
