"""Every query against its SQL on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from varigrid.queries import QUERIES, SQL, flagship

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    return str(v.normalize()) if isinstance(v, decimal.Decimal) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found.fetchall())


def test_flagship_has_four_rows(spark):
    assert flagship(spark, str(DATA)).count() == 4


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_live_status_keeps_rows_and_state_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("varigrid.sources.shared_dir", lambda _: f"file://{tmp_path}")
    files = QUERIES["live_status"](spark, str(DATA)).inputFiles()
    assert files and all(f"{tmp_path}/live-status-" in f for f in files)
    assert list(tmp_path.glob("live-status-*/state/state")) and not spark.catalog.tableExists("live_status_rows")
