"""Six-digit ids repeat from a million keys on: queries still give the rows of their SQL."""

import duckdb
import pytest
from arcwright import plans
from arcwright.functions import text as X

from .test_queries import rows_of

DATA = "/root/testdata/sf0.001"
KEYS = "SELECT unnest(range(100000, 100040) || range(1000000, 1000400)) AS k"


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("big"))
    c = duckdb.connect()
    for table, key in (("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        one = "1 = 1" if table != "lineitem" else "l_orderkey = (SELECT min(l_orderkey) FROM t)"
        few = "LIMIT 1" if table != "lineitem" else ""
        c.execute(f"CREATE OR REPLACE TABLE t AS SELECT * FROM '{DATA}/{table}.parquet'")
        c.execute(f"COPY (SELECT x.* REPLACE (k AS {key}) FROM (SELECT * FROM t WHERE {one} {few}) x, ({KEYS}) n) TO '{at}/{table}.parquet'")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
    return at, c


def same(got, want):
    got, want = rows_of(got), rows_of(want)
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 1e-5) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ["domain_percentile_descending", "evidence_matrix", "evidence_override", "filled_controls", "spearman", "tier_counts"])
def test_rows_of_one_id(name, spark, big):
    at, c = big
    same(plans.QUERIES[name](spark, at).toPandas(), c.execute(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name,rank", [("review_shortlist", "review_rank"), ("gravity_first", "gravity_first_rank")])
def test_ranks_of_one_id(name, rank, spark, big):
    """Rows that tie in all of the SQL's order may change places; everything else is as in the SQL."""
    at, c = big
    got, want = plans.QUERIES[name](spark, at).toPandas(), c.execute(plans.ORACLES[name]).df()
    assert sorted(got[rank]) == sorted(want[rank]) == list(range(1, len(want) + 1))
    assert got.sort_values(rank)["candidate_id"].tolist() == want.sort_values(rank)["candidate_id"].tolist()
    same(got.drop(columns=rank), want.drop(columns=rank))


def test_only_the_named_references_are_decoded(spark):
    pages = {"<p>1 &lt; 2&nbsp;&amp;lt;</p> &amp p": "1 < 2 &lt; &amp p", "&eacute;&copy;\n\ta": "&eacute;© a"}
    df = spark.createDataFrame([(c,) for c in pages], "c string")
    from arcwright.plans.text_queries import _REFERENCES

    assert {r["c"]: r["v"] for r in df.select("c", X.visible_text("c", _REFERENCES).alias("v")).collect()} == pages
