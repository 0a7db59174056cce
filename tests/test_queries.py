"""Every registered query of the core with SQL gives what the SQL gives, on the smallest driver tables if present."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")
CORE = [n for m in entry._modules() if not m.__name__.startswith("inkatlas.llm") for n in m.QUERIES]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(CORE) == len(set(CORE)) >= 60


@pytest.mark.skipif(not TABLES.exists(), reason="driver tables are absent")
@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, str(TABLES))
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
