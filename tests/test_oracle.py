"""Every query that has SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from lectern.plans import registry

DATA = Path("/root/testdata/sf0.001")


def rows(cols, got):
    def plain(x):
        return round(float(x), 5) if isinstance(x, float) else str(x)

    return sorted([tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in got])


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    got = duck.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, got.fetchall())


def test_entry_imports_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert set(entry.oracle_sql()) <= set(entry.queries()) == set(registry.queries())
