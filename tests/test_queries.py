"""Every registered query of the lake against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from moraine import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, table):
    place = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in place) for r in table), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sql, name):
    df = catalogue.queries()[name](spark, DIR)
    want = sql.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
