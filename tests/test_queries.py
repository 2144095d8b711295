"""Every registered query with SQL gives its rows on the smallest tables."""

import os

import duckdb
import pytest
from arcwright import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(pdf):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return v.item() if hasattr(v, "item") else v

    cols = sorted(pdf.columns)
    rows = [tuple(plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    # by what isn't a float first, so a last digit doesn't decide which rows are compared
    return cols, sorted(rows, key=lambda r: (repr([v for v in r if not isinstance(v, float)]), [round(v, 4) for v in r if isinstance(v, float)]))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(name, spark, duck):
    got = rows_of(plans.QUERIES[name](spark, DATA).toPandas())
    want = rows_of(duck.execute(plans.ORACLES[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 1e-5) or x == y for x, y in zip(a, b, strict=True)), (a, b)
