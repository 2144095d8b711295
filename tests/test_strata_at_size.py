"""A shuffle within strata: rows go once to ranges of draws, however many there are, and rows of one id stay apart."""

import hashlib

import numpy as np
import pytest
from arcwright.operators import stats as T


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < a).sum() + 1 + ((v == a).sum() - 1) / 2 for a in v])


def rows_of(n):
    rng = np.random.RandomState(8)
    return [(f"k{i:04d}", ["a", "b", None][min(2, rng.randint(9))], float(rng.randint(40)), float(rng.randint(30))) for i in range(n)]


@pytest.mark.parametrize("shuffled", [40, 700, 200_000])
def test_shuffles_are_those_of_the_rows(shuffled, spark, monkeypatch):
    monkeypatch.setattr(T, "SHUFFLED", shuffled, raising=False)
    rows = rows_of(300) + [("lone", "c", 1.0, 2.0), ("gap", "a", None, 5.0)]
    out = T.stratified_null(spark.createDataFrame(rows, "k string, s string, x double, y double"), "k", ["s"], "x", "y", 4, 11)
    got = {r["rep"]: r["rho"] for r in out.collect()}
    rows = [r for r in rows if r[2] is not None]
    rx, ry = ranks([r[2] for r in rows]), ranks([r[3] for r in rows])
    for rep in range(-1, 4):
        moved = ry.copy()
        for s in ("a", "b", "c", None):
            own = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: rows[i][0])
            drawn = sorted(own, key=lambda i: (int(hashlib.md5(f"11:{rep}:{rows[i][0]}".encode()).hexdigest()[:8], 16), rows[i][0]))
            moved[own] = ry[own] if rep < 0 else ry[drawn]
        assert abs(got[rep] - np.corrcoef(rx, moved)[0, 1]) < 1e-12
    assert sorted(got) == [-1, 0, 1, 2, 3]


def test_rows_of_one_id_are_not_multiplied(spark):
    rows = [(f"k{i % 60}", s, x, y) for i, (_, s, x, y) in enumerate(rows_of(200))]
    got = {r["rep"]: r["rho"] for r in T.stratified_null(spark.createDataFrame(rows, "k string, s string, x double, y double"), "k", ["s"], "x", "y", 2, 11).collect()}
    assert abs(got[-1] - np.corrcoef(ranks([r[2] for r in rows]), ranks([r[3] for r in rows]))[0, 1]) < 1e-12
    assert all(abs(got[i]) < 0.5 for i in (0, 1))


def test_no_rows_or_no_spread(spark):
    schema = "k string, s string, x double, y double"
    assert [tuple(r) for r in T.stratified_null(spark.createDataFrame([("a", "s", None, 1.0)], schema), "k", ["s"], "x", "y", 2, 1).collect()] == [(-1, None)]
    got = T.stratified_null(spark.createDataFrame([(f"k{i}", "s", 1.0, float(i)) for i in range(5)], schema), "k", ["s"], "x", "y", 2, 1).collect()
    assert sorted(r["rep"] for r in got) == [-1, 0, 1] and all(r["rho"] is None for r in got)
