import importlib.util
import os
import re

from .conftest import ROOT


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert "customer_name" in df.columns and "item_summary" in df.columns


def test_every_oracle_has_a_query():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    # The names that the driver prescribes for the training-data queries stand beside the books' own.
    assert all(re.match(r"q_|op[0-9]+_|pipeline$", k) for k in q)
