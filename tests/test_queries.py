"""Every named query of the library, without the optional subpackage, against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gristmill.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return con


def plain(frame):
    value = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(value, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    assert len(got)


def test_entry_works_without_the_optional_part(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in ("corpus_pipeline", "gristmill.llm", "gristmill.llm.registry"):
        monkeypatch.delitem(sys.modules, name, raising=False)

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "gristmill.llm"):
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
