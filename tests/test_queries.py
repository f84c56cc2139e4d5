"""Every query with SQL against DuckDB over the small tables."""

import math

import pytest

from tallyrook import jobs


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(jobs.ORACLE_SQL))
def test_against_sql(spark, sf_dir, oracle, name):
    found = jobs.QUERIES[name](spark, sf_dir)
    rows, expect = sorted(map(tuple, found.collect()), key=repr), oracle(jobs.ORACLE_SQL[name], sf_dir, found.columns)
    assert len(rows) == len(expect)
    for r, e in zip(rows, expect, strict=True):
        assert all(map(same, r, e)), (r, e)


@pytest.mark.parametrize("name", sorted(set(jobs.QUERIES) - set(jobs.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    found = jobs.QUERIES[name](spark, sf_dir)
    assert len(set(found.columns)) == len(found.columns)
    assert found.count() > 0
