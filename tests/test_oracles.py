"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from driftline.queries import ORACLES, QUERIES


def norm(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    fix = lambda v: round(v, 4) if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted(([fix(r[k]) for k in order] for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert norm(rows, df.columns) == norm(got.fetchall(), columns)
