"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from tessera.plans.files import FILE_QUERIES
from tessera.plans.named import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

CORE = set(QUERIES) | set(FILE_QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _spark_type(duck: str) -> str:
    d = duck.upper()
    if d.startswith("DECIMAL"):
        return "decimal" + d[len("DECIMAL"):].lower().replace(" ", "")
    return {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "INTEGER": "int",
            "BOOLEAN": "boolean"}.get(d, d.lower())


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r))
    return sorted(out, key=repr)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "x"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert CORE <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = _norm(tuple(r) for r in df.collect())
    sql = entry.oracle_sql()[name]
    res = duck.execute(sql)
    assert df.columns == [d[0] for d in res.description]
    assert rows == _norm(res.fetchall())
    duck_types = [_spark_type(r[1]) for r in duck.execute(f"DESCRIBE {sql}").fetchall()]
    assert [f.dataType.simpleString() for f in df.schema.fields] == duck_types
