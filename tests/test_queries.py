"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gridstrata.plans import products, registry  # noqa: F401 (products adds to the registry)

DATA = "/root/testdata/sf0.001"


def rows(names, values):
    def plain(x):
        x = x.item() if hasattr(x, "item") else x
        return None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x

    return sorted((tuple(map(plain, r)) for r in values), key=repr)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = rows(names, df.select(*names).collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    found = con.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    want = rows(names, found)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)
