"""Every engine query against its DuckDB SQL, on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tesserae import queries

DATA = Path("/root/testdata/sf0.001")


def shown(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_equals_oracle(spark, duck, name):
    frame = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    relation = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    found = sorted((tuple(shown(r[c]) for c in columns) for r in frame.collect()), key=repr)
    wanted = sorted((tuple(shown(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert found == wanted
