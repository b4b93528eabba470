"""Every query of the event library gives the rows of its SQL."""

import pytest

from eventlens import catalog

from .compare import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(name, spark, sf, con):
    same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(name, spark, sf):
    df = catalog.queries()[name](spark, sf)
    assert df.columns and all(len(r) == len(df.columns) for r in df.collect())


@pytest.mark.parametrize("name", ["d_charset_marks", "d_charset_marks_windows", "d_proportion_shift_marks", "d_interval_marks"])
def test_gates_fire(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() >= 1
