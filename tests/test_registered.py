"""Registered queries against their SQL, on pages that the standard tables hold few of, and in bounded memory."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as registered
from weftline import session
from weftline.functions import lazy
from weftline.operators import api, extract, frontier, shape


def against_sql(spark, tmp_path, name, **tables):
    """The rows of a query and of its SQL over ``tables`` (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = str(tmp_path / f"{table}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = [tuple(r) for r in registered.queries()[name](spark, str(tmp_path)).collect()]
    return sorted(got, key=repr), sorted(con.execute(registered.oracle_sql()[name]).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["extract_ladder", "extract_selectors", "page_title"])
def test_references_cut_off(spark, tmp_path, name):
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>text</p></article></body></html>"
    heads = ["a &amp; b &amp", "a &am", "a &", "a &quot", "&lt;b&gt; &quot;c&quot; &amp x", "plain"]
    pages = [(2 * k + 1, f"https://a.com/p/{k}", page.format(h)) for k, h in enumerate(heads)] + [(2, "https://a.com/none", "<html><head><title>t</title></head><body>x</body></html>")]
    got, want = against_sql(spark, tmp_path, name, pages=(pages, "page_id bigint, url string, html string"))
    assert got == want


def test_pages_go_through_python_in_pieces(spark):
    few = lazy.pieces((pa.array(["u"] * 300), pa.array(["<p>"] * 299 + [None])))
    assert [len(p) for p in few] == [128, 128, 44]
    assert [len(p) for p in lazy.pieces((pa.array(["u"] * 5), pa.array(["x" * 600_000] * 5)))] == [2, 2, 1]


def test_links_and_next_page_of_one_parse(spark):
    html = '<link rel="next" href="/2.pdf"><a href="/a">a</a><a href="/b.css">b</a><a href="http://10.0.0.1/">c</a><a href="/a#x">a</a>'
    edges = frontier._edges(spark.createDataFrame([("http://h.com/", html), ("http://i.com/", None)], "url string, html string"))
    assert {tuple(r) for r in edges.collect()} == {("http://h.com/", "http://h.com/2.pdf", 0), ("http://h.com/", "http://h.com/a", 1)}
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_shaped_pages_leave_a_batch_in_pieces(spark):
    n = 1000
    batch = (pa.array(["http://a.com/"] * n), pa.array(["<title>t</title><p>text"] * n), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()))
    got = list(shape.shaper().func(iter([batch])))
    assert max(map(len, got)) <= 128 and sum(map(len, got)) == n and {r["title"] for p in got for r in p.to_pylist()} == {"t"}


def test_model_cost_needs_no_shuffle_by_model(spark):
    rows = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 1, 1), (None, 1, 1)], "model_id string, input_tokens int, output_tokens int")
    prices = spark.createDataFrame([("a", 1.0, 2.0)], "model_id string, input_usd double, output_usd double")
    cost = extract.model_cost(rows, prices, (3.0, 4.0))
    assert sorted(round(r["cost_usd"] * 1e6) for r in cost.collect()) == [7, 7, 12, 24]
    assert "hashpartitioning" not in cost._jdf.queryExecution().executedPlan().toString()


def test_extraction_leaves_a_batch_in_pieces(spark):
    n = 1000
    rung = extract._rung(lambda html, rules: {"data": html, "fields": {"a": "b"}} if html else 1 / 0)
    got = list(rung.func(iter([(pa.array(["x"] * n), pa.nulls(n, pa.map_(pa.string(), pa.string())))])))
    assert max(map(len, got)) <= 128 and sum(map(len, got)) == n and got[0].to_pylist()[0]["fields"] == [("a", "b")]


def test_hot_url_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(api, "HOT", 10)
    urls = [(k, "http://gone.com/") for k in range(95)] + [(k, "http://a.com/") for k in range(95, 120)] + [(120, "http://b.com/"), (121, None)]
    pages = spark.createDataFrame([("http://a.com/", "<h1>a</h1>" * 30), ("http://b.com/", "<h1>b</h1>" * 30)], "url string, html string")
    got = api.batch_scrape(spark.createDataFrame(urls, "pos int, url string"), pages).select("pos", "url", "error", "title").collect()
    title = {"http://a.com/": "a", "http://b.com/": "b"}
    assert [tuple(r) for r in got] == [(p, u, None if u in title else "not fetched", title.get(u)) for p, u in urls]


def test_partitions_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(50_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "PART_BYTES", 10_000)
    assert session.dealt(table, table, "id").rdd.getNumPartitions() > 10
