"""Pages tables without rows, with one very long page, and with columns whose names clash."""

from varigrid.llm import url_filter, warc

SCHEMA = "page_id long, url string, html string, digest string, host string, offset long"


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(none).count() == 0
    assert url_filter.judge(none, spark.createDataFrame([("x",)], "canonical string"), []).count() == 0


def test_a_very_long_page_and_url(spark):
    rows = [(1, "http://a.com/" + "p" * 100_000, "é" * 3_000_000, "d", "h", 5), (2, None, "é" * 3_000_000, None, None, None), (3, "http://b.com/x", "", "d", "h", 1)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (6_000_000, "response", None), 2: (6_000_000, "revisit", 1), 3: (0, "response", None)}
    listed = pages.where("page_id = 1").select(url_filter.canonical(url_filter.host(pages.url), url_filter.path(pages.url)).alias("canonical"))
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(pages, listed, []).collect()}
    assert verdicts == {1: "block", 2: "allow", 3: "allow"}
