"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from docloom.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or x != x:
            return "NULL"
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.9g}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
