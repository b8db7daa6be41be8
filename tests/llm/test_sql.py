"""Queries against their SQL, on the smallest tables and on awkward ones."""

import duckdb
import pytest

from tests.llm.cases import texts
from varigrid.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def same(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == DATA else '/*.parquet'}')")
    found = con.execute(ORACLES[name])
    cols = [x[0] for x in found.description]
    want = sorted(map(str, found.fetchall()))
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want and want


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Null texts, sources and urls; copies; lines that many documents share; a template with fields; a column that clashes."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i * 3, t, f"src{i % 3}" if i % 11 else None, i) for i, t in enumerate(texts(n=80))]
    footer = "Contact us for more about this page today."
    for i in range(70):
        own = " ".join(f"own{i}x{j} plain{(i * j) % 97}" for j in range(40 if i % 5 else 6))
        rows.append((1000 + i, f"{own}\n{footer}\n\nposted by user{i} on day {i} of the month\n" + ("See all of the terms of use\n" * (i % 3)), "hot" if i % 2 else None, i))
    item = "Alpha beta-gamma delta; ÉPSILON zeta eta theta iota kappa lambda mu nu xi omicron"
    rows += [(2000 + i, t, None if i % 2 else "bench", i) for i, t in enumerate([item, item.upper(), item.replace(" ", "\n#"), "x " + item[6:], item[:-30], "one two", "so ONE, two three", "tiny", "a tiny b tiny"])]
    rows = [(*r, None if r[3] % 3 else "en", len(r[1] or "") if r[3] % 4 else None) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n long, lang string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    items = [(1, item), (2, item[6:]), (10, "One two."), (3, "tiny"), (3, "TINY"), (4, None), (5, ""), (6, "..."), (7, item + " " + item), (8, "not in any of the texts at all, ever, is this one"), (None, "b tiny")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?q#f", "http://example.com/en/7", "http://notexample.com/en/7/x", "https://a.example.net/de/8/", "https://net/de/1", "x://y://z/p", "http://m.site.org/es/1", "http://site.org/p.html", "http://www.site.org/p//", "http://site.org?es", "http://É.org/es/ü"]
    html = [None, "", "<p>é</p>", "<p>same</p>", "y" * 2000, "<p>same</p>"]
    pages = [(100 - i, urls[i % len(urls)], html[i % len(html)], i) for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string, host long").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_smallest_tables(spark, name):
    same(spark, name, DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_awkward_tables(spark, awkward, name):
    same(spark, name, awkward)
