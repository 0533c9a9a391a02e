"""Trees, Markdown, main content, chunks, links, dispatch and metadata."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pydantic import BaseModel
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions import metadata, shaping
from weftline.functions.htmltree import Selector, parse, select_first
from weftline.operators import extract, shape

PAGE = """<html><head><title>Tab</title><meta property="og:title" content="Real title"></head><body><header>top junk</header><nav><a href="/n">nav junk</a></nav>
<article><h1>Main</h1><p>See <strong>demo</strong> and <a href="/topic">a topic</a> here, which is long enough to count as text.</p><h2>List</h2><ul><li>one</li><li>two</li></ul>
<ol><li>x</li><li></li><li>y</li></ol><pre><code>code = 1
</code></pre><table><tr><th>Plan<th>Cost</tr><tr><td>A</td></tr></table><blockquote>said</blockquote><img src="/i.png" alt="pic"><hr></article>
<div class="ad">buy</div><footer>copyright junk</footer>"""


def test_markdown():
    md = shaping.markdown(parse(PAGE))
    for part in ("# Main", "## List", "**demo**", "[a topic](/topic)", "- one", "1. x\n2. y", "```\ncode = 1\n```", "| Plan | Cost |", "| A |  |", "> said", "![pic](/i.png)", "---"):
        assert part in md
    assert "junk" not in md and "buy" not in md
    assert shaping.title(parse(PAGE)) == "Real title"


@pytest.mark.parametrize("html,want", [("", ""), ("   ", ""), ("<div></div>", "\n"), ("<p>a<p>b", "a\n\nb\n"), ("<h1>x<h2>y", "# x\n\n## y\n")])
def test_markdown_edges(html, want):
    assert shaping.shape(html).markdown == want


def test_open_formatting_goes_on():
    md = shaping.markdown(parse("<p><b>one<p>two</b> three"))
    assert md == "**one**\n\n**two** three\n"


def test_deep_nesting():
    assert "text" in shaping.markdown(parse("<p>" + "<b><i>" * 3000 + "text"))


def test_main_content():
    assert "Main" in shaping.main_content(PAGE) and "junk" not in shaping.main_content(PAGE)
    assert shaping.main_content("<p>x") == "<p>x" and shaping.main_content("") == ""


def test_title_falls_back_to_heading():
    assert shaping.title(parse("<article><h1>Head</h1></article>")) == "Head"


def test_links_and_next():
    root = parse('<link rel="next" href="/p2"><a href="a">1</a><a href="#x">2</a><a href="mailto:x@y">3</a><a href="//h.org/z">4</a><a href="javascript:1">5</a><a>6</a>')
    assert shaping.links(root, "https://e.com/d/") == ["https://e.com/d/a", "https://h.org/z"]
    assert shaping.next_link(root, "https://e.com/d/") == "https://e.com/p2"
    assert shaping.next_link(parse('<a rel="nofollow next" href="?p=3">'), "https://e.com/d") == "https://e.com/d?p=3"


def test_chunk_trails_follow_list_length():
    trails = [c.trail for c in shaping.chunks("### a\nx\n## b\ny\n# c\n### d\nz\n")]
    assert trails == [["a"], ["a", "b"], ["c"], ["c", "d"]]


def test_overlap_leads_but_is_outside_the_range():
    md = "# h\n" + "\n\n".join(chr(97 + k) * 90 for k in range(6))
    parts = shaping.chunks(md, 200, 10)
    assert len(parts) > 2 and parts[1].text.startswith(parts[0].text[-10:])
    body = md.encode()
    assert all(c.text.endswith(body[c.start : c.end].decode()) for c in parts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é日\n#*. ", max_size=400), st.integers(5, 80), st.integers(0, 10))
def test_byte_ranges_round_trip(md, target, overlap):
    raw = md.encode()
    for c in shaping.chunks(md, target, overlap):
        own = raw[c.start : c.end].decode()
        assert own == own.strip() and c.text.endswith(own)


@pytest.mark.parametrize(
    "kind,body,raw,want",
    [
        ("application/json", '{"k": [7, {"m": 1}]}', None, "json"),
        ("application/octet-stream", "  [1, 2]", None, "json"),
        ("text/plain", "{not json", None, "html"),
        ("text/plain", "hello", None, "text"),
        ("", "<p>x", b"%PDF-1.4", "pdf"),
        ("text/xml", "<rss><channel><title>T</title><item><title>i</title><link>u</link></item></channel></rss>", None, "feed"),
        ("text/xml", "<a/>", None, "html"),
        ("", '{"a": 1}', None, "html"),
    ],
)
def test_dispatch(kind, body, raw, want):
    assert shaping.shape(body, kind, raw).kind == want


def test_feed():
    atom = '<feed xmlns="urn:atom"><title>F</title><entry><title>E</title><link href="http://x"/><updated>d</updated><summary>s</summary></entry></feed>'
    name, items = shaping.feed_items(atom)
    assert name == "F" and items == [{"title": "E", "link": "http://x", "date": "d", "description": "s"}]
    assert shaping.feed_markdown(name, items) == "# F\n- **E** (http://x)\n  s"


def test_selectors():
    root = parse('<div id="m"><p class="a b" data-x="q r">1</p><section><p>2</p><p>3</p></section></div>')
    pick = lambda css: [n.text() for n in Selector(css).select(root)]
    assert pick("p.a") == ["1"] and pick("#m > p") == ["1"] and pick("#m p") == ["1", "2", "3"] and pick("p[data-x~=q]") == ["1"]
    assert pick("section p:nth-of-type(2)") == ["3"] and pick("p.a, section > p") == ["1", "2", "3"]
    assert select_first(root, "p:hover") is None and select_first(root, "") is None


class Item(BaseModel):
    name: str
    price: str


class Recipe(BaseModel):
    name: str
    ingredients: list[str]


class Offers(BaseModel):
    items: list[Item] | None = None


LD = '<script type="application/ld+json">{"name": "Widget Pro", "offers": {"price": "42.00"}}</script>'


def test_metadata_rung():
    got = extract.from_metadata(LD, Item)
    assert json.loads(got["data"]) == {"name": "Widget Pro", "price": "42.00"} and got["source"] == "json-ld"
    micro = '<div itemscope><span itemprop="name">W</span><meta itemprop="price" content="9.99"></div>'
    assert json.loads(extract.from_metadata(micro, Item)["data"]) == {"name": "W", "price": "9.99"}
    graph = '<script type="application/ld+json">{"@graph": [{"name": "Soup", "ingredients": ["a", "b"]}]}</script>'
    assert json.loads(extract.from_metadata(graph, Recipe)["data"])["ingredients"] == ["a", "b"]
    for bad in ("", "<title>only</title>", '<script type="application/ld+json">{bad</script>', LD.replace('"42.00"', "42")):
        assert extract.from_metadata(bad, Item) is None


def test_metadata_times():
    root = parse('<time datetime="2" class="updated"></time><time datetime="1"></time><time datetime="3" itemprop="datePublished"></time>')
    assert metadata.times(root) == {"datepublished": "3"}


def test_selector_and_model_rungs():
    html = '<h1 class="t">W</h1><span class="p">9</span><ul><li><b>n</b><i>1</i></li><li><b>m</b><i>2</i></li></ul>'
    assert json.loads(extract.from_selectors(html, Item, {"name": "h1.t", "price": ".p"})["data"]) == {"name": "W", "price": "9"}
    assert extract.from_selectors(html, Item, {"name": "h1.t"}) is None
    rows = json.loads(extract.from_selectors(html, Offers, {"items": 'li | {"name": "b", "price": "i"}'})["data"])["items"]
    assert [r["name"] for r in rows] == ["n", "m"]
    got = extract.from_model("# Title\nprice: 3", Item, extract.mock_model)
    assert json.loads(got["data"]) == {"name": "Title", "price": "3"} and got["source"] == "llm"
    assert extract.from_model("x", Item, lambda p, m: '```json\n{"name": 1}\n```')["source"] == "llm-unvalidated"
    assert extract.from_model("x", Item, lambda p, m: "no") is None


def test_ladder(spark):
    pages = spark.createDataFrame([("http://a.com/p/1", LD, ""), ("http://a.com/p/2", "<h1 class=t>W</h1><i class=p>1</i>", ""), ("http://a.com/p/3", "<p>x", "# T\nprice: 7"), ("http://a.com/p/4", None, None)], "url string, html string, markdown string")
    h = schemas.schema_hash(Item)
    rules = spark.createDataFrame([("a.com", "p/:id", h, "name", "h1.t"), ("a.com", "p/:id", h, "price", "i.p")], "host string, path_template string, schema_hash string, field_name string, selector string")
    got = {r["url"][-1]: r["extraction"] for r in extract.extract(pages, Item, rules, extract.mock_model).collect()}
    assert got["1"]["method"] == "metadata" and got["2"]["method"] == "selector" and got["3"]["method"] == "llm"
    assert got["4"]["method"] == "llm" and got["4"]["source"] == "llm-unvalidated"


def counting(path, reply):
    """A model that leaves a line in a file for each call."""

    def answer(prompt, model):
        with open(path, "a") as f:
            f.write(prompt[:20].replace("\n", " ") + "\n")
        return reply

    return answer


def calls(path):
    return len(path.read_text().splitlines()) if path.exists() else 0


WIDGET = "<h1 class=t>Green Widget</h1><b class=cost>12 EUR</b>"
REPLY = 'Here: {"name": "Green Widget", "price": "12 EUR"}\nSELECTORS: {"name": "h1.t", "price": ".cost", "x": ".none"}'


def test_the_model_is_asked_once_for_each_row_left(spark, tmp_path):
    pages = spark.createDataFrame([(f"http://a.com/p/{k}", LD if k % 4 == 0 else "<p>x", f"page {k}") for k in range(100)], "url string, html string, markdown string").repartition(5)
    log = tmp_path / "calls"
    got = extract.extract(pages, Item, answer=counting(log, '{"name": "n", "price": "p"}'))
    assert {r["method"]: r["n"] for r in got.groupBy("extraction.method").agg(F.count("*").alias("n")).collect()} == {"metadata": 25, "llm": 75}
    got.collect()
    assert calls(log) == 75


def test_budget_stops_calls(spark, tmp_path):
    pages = spark.createDataFrame([(f"http://a.com/{k % 7}/{k}", "<p>x", "") for k in range(20)], "url string, html string, markdown string")
    for n, (most, cost) in enumerate([(0, None), (3, None), (None, 0.0025), (5, 0.001)]):
        log = tmp_path / f"calls{n}"
        got = extract.extract(pages, Item, answer=counting(log, '{"name": "n", "price": "p"}'), max_calls=most, max_cost=cost, call_cost=0.001).collect()
        want = [0, 3, 3, 1][n]
        assert len(got) == 20 and calls(log) == want and sum(r["extraction"]["method"] == "llm" for r in got) == want


def test_verified_selectors_are_learned_and_used(spark, tmp_path):
    from weftline.operators import runs

    page = spark.createDataFrame([("http://a.com/p/1", WIDGET, "w")], "url string, html string, markdown string")
    first = extract.extract(page, Item, answer=counting(tmp_path / "a", REPLY))
    assert first.collect()[0]["extraction"]["learned"] == {"name": "h1.t", "price": ".cost"}
    events = extract.rule_events(first, Item, 1.0)
    rules = runs.selector_rules(events)
    again = page.withColumn("url", F.lit("http://a.com/p/2"))
    second = extract.extract(again, Item, rules, counting(tmp_path / "b", REPLY))
    assert second.collect()[0]["extraction"]["method"] == "selector" and calls(tmp_path / "b") == 0
    other = extract.extract(page.withColumn("url", F.lit("http://b.a.com/p/1")), Item, rules, counting(tmp_path / "c", REPLY))
    assert other.collect()[0]["extraction"]["method"] == "llm" and calls(tmp_path / "c") == 1
    for k in (2.0, 3.0, 4.0):  # the page changes: three failures evict
        bad = extract.extract(page.withColumn("html", F.lit("<p>new")), Item, runs.selector_rules(events), counting(tmp_path / "d", '{"name": "n", "price": "p"}'))
        events = events.unionByName(extract.rule_events(bad, Item, k))
    assert runs.selector_rules(events).count() == 0 and calls(tmp_path / "d") == 3


def test_selectors_that_find_something_else_are_not_learned():
    values = {"name": "Green Widget", "price": "12 EUR", "n": 3, "items": []}
    rules = {"name": ".cost", "price": "b", "n": "h1", "items": 'b | {"x": "i"}', "gone": "em"}
    assert extract.verified(WIDGET, rules, values) == {"price": "b", "n": "h1"}
    assert extract._selector_block('{"a": 1} SELECTORS: {"a": "h1", "l": {"__list__": "ul > li", "x": "b"}, "bad": 3}') == {"a": "h1", "l": 'ul > li | {"x": "b"}'}


def test_pins(spark):
    page = spark.createDataFrame([("http://a.com/p/1", WIDGET, "w")], "url string, html string, markdown string")
    with pytest.raises(extract.PinError):
        extract.extract(page, Item, answer=extract.mock_model, pin="x/y@1", provider="x", model_id="y", prompt_hash="2")
    with pytest.raises(extract.PinError):
        extract.extract(page, Item, strict_pin=True)
    assert extract.extract(page, Item, pin="X/y@1", provider="x", model_id="Y", prompt_hash="1").count() == 1


def test_one_parse_per_page(spark):
    pages = spark.createDataFrame([("http://a.com", PAGE)], "url string, html string")
    df = shape.shape(pages).select("shaped.title", "shaped.markdown", F.size("shaped.chunks"))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    row = df.collect()[0]
    assert row["title"] == "Real title"


def test_shape_edges(spark):
    pages = spark.createDataFrame([(None, None), ("http://a.com", ""), ("http://b.com", "<p>x</p>" * 20000)], "url string, html string")
    rows = shape.shape(pages).select("url", "shaped.*").collect()
    assert [r["error"] for r in rows] == [None] * 3 and [len(r["chunks"]) > 0 for r in rows] == [False, False, True]


def test_chunk_dedup(spark):
    pages = spark.createDataFrame([("b", "<h1>x</h1><h2>y</h2>"), ("a", "<h1>x</h1>")], "url string, html string")
    kept = shape.distinct_chunks(shape.chunk_rows(pages)).select("url", "text").collect()
    assert {(r["url"], r["text"]) for r in kept} == {("a", "# x"), ("b", "## y")}


def test_schema_compiler():
    t = schemas.struct_type(Offers)
    assert t["items"].dataType.simpleString() == "array<struct<name:string,price:string>>" and t["items"].nullable
    assert schemas.list_fields(Offers) == {"items": Item} and schemas.required_fields(Item) == ["name", "price"] and len(schemas.schema_hash(Item)) == 16
