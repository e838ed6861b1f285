"""Every registered query against the second engine, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestar.registry import ORACLE_SQL, QUERIES
from lodestar.session import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return v.isoformat() if hasattr(v, "isoformat") else repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", ["array_all", "array_any"])
def test_float_elements_at_the_bound(spark, tmp_path, name):
    con, path = duckdb.connect(), tmp_path / "embeddings.parquet"
    values = "(1, [0.35, 0.1]), (2, [0.34999]), (3, [0.35001, 0.1]), (4, []), (5, [0.1, NULL]), (6, NULL), (7, ['nan'::float, 0.1])"
    con.execute(f"copy (select vec_id::bigint as vec_id, embedding::float[] as embedding from (values {values}) t(vec_id, embedding)) to '{path}' (format parquet)")
    assert con.execute(f"select typeof(embedding) from '{path}' limit 1").fetchone() == ("FLOAT[]",)
    con.execute(f"create view embeddings as select * from '{path}'")
    ours = sorted(r["vec_id"] for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert ours == sorted(r[0] for r in con.execute(ORACLE_SQL[name]).fetchall()) == {"array_all": [2, 4], "array_any": [3, 7]}[name]
