"""Every registered query against its DuckDB oracle (sf0.001), and every
derived table against its DuckDB twin."""

import pytest

from meterbook.plans.oracle import VIEWS, with_views
from meterbook.plans.registry import load_all
from tools.oracle_check import digest

from .conftest import SMALL

REG = load_all()
WITH_ORACLE = sorted(n for n, q in REG.items() if q.oracle)
ROWS_ONLY = sorted(n for n, q in REG.items() if not q.oracle)


def _compare(df, cur):
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    h1, l1 = digest(cols, rows)
    h2, l2 = digest(ocols, orows)
    assert h1 == h2, (sorted(set(l1) - set(l2))[:3], sorted(set(l2) - set(l1))[:3])


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_fixture_view(book, duck, name):
    _compare(getattr(book, name), duck.execute(with_views(f"SELECT * FROM {name}")))


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_query_matches_oracle(spark, duck, name):
    q = REG[name]
    _compare(q.build(spark, SMALL), duck.execute(q.oracle))


if ROWS_ONLY:  # every query currently has an oracle
    @pytest.mark.parametrize("name", ROWS_ONLY)
    def test_rows_only_query_runs(spark, name):
        df = REG[name].build(spark, SMALL)
        assert df.count() > 0
