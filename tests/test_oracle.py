"""Every registered query that SQL can express gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as contract
from check import compare, duck

ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_names_match():
    assert set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, folder, name):
    ok, note = compare(spark, con, name, folder, ORACLE[name])
    assert ok, note


def test_entry_marks_one_peak(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 24
    peak = [r for r in rows if r["is_peak"]]
    assert len(peak) == 1 and peak[0]["Quantity"] == max(r["Quantity"] for r in rows)
