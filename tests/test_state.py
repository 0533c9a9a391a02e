"""URLs, policy, run history, frontier, exports, watches and streams."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import policy, signals, urls
from weftline.operators import api, export, frontier, runs
from weftline.sources import state
from weftline.streaming import watch


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_normalize(spark):
    cases = {
        "HTTP://User@Example.COM:80/A?b=2&a=1&utm_source=x&&ref=1#f": "http://user@example.com/A?a=1&b=2",
        "https://e.com:443": "https://e.com/",
        "https://e.com:8443/x/": "https://e.com:8443/x/",
        "https://e.com/?referrer=1": "https://e.com/",
    }
    got = one(spark, urls.normalize, *cases)
    assert got == list(cases.values()) and one(spark, urls.normalize, *got) == got
    assert one(spark, urls.normalize, None) == [None]


def test_url_parts(spark):
    assert one(spark, urls.host, "http://u:p@H.com:80/x", "http://[::1]:8/") == ["h.com", "[::1]"]
    assert one(spark, urls.canonical_host, "http://www.a.com:81/") == ["a.com:81"]
    assert one(spark, urls.path_template, "http://a/Shop/12/x", "http://a/", "http://a/deadbeef/1-a/z", "http://a/a-1") == ["shop/:id", "", ":id/:id", "a-1"]
    assert one(spark, urls.is_asset, "http://a/x.PDF", "http://a/x.pdf/y", "http://a/x") == [True, False, False]
    assert one(spark, urls.source_rewrite, "https://fr.m.wikipedia.org/wiki/A_b/c", "https://es.wikipedia.org/wiki/Special:X", "https://x.org/wiki/A", "https://de.wikibooks.org/w/index.php?a=1&title=A+b") == ["https://fr.wikipedia.org/api/rest_v1/page/html/A_b%2Fc", None, None, "https://de.wikibooks.org/api/rest_v1/page/html/A%20b"]
    assert one(spark, urls.input_target, "e.com", "ftp://x", " ", "http://y") == ["https://e.com", None, None, "http://y"]


@pytest.mark.parametrize("url,ok", [("http://127.0.0.1/", False), ("http://2130706433", False), ("http://0x7f.1", False), ("http://0177.0.0.1", False), ("http://[::1]/", False), ("http://10.0.0.5", False), ("http://8.8.8.8/", True), ("http://localhost", False), ("http://x.internal/", False), ("ftp://e.com", False), ("http://e.com.", True), ("http://", False), (None, False), ("http://169.254.169.254/", False)])
def test_guard(spark, url, ok):
    assert one(spark, policy.fetchable, url) == [ok]


PII_CASES = [
    ("ann.lee@sample.org or +1 212-555-0987.", ["email", "phone"]),
    ("user@domain.123", []),
    ("a..b@x.com", None),
    ("GB82WEST12345698765432", ["iban"]),
    ("GB82WEST1234", []),
    ("12/31/2023", []),
]


def test_pii(spark):
    for text, want in PII_CASES:
        kinds = sorted({k for k, *_ in policy.scan_pii(text)})
        if want is not None:
            assert kinds == want and one(spark, policy.pii_kinds, text) == [want], text
    assert "credit_card" in one(spark, policy.pii_kinds, "4242 4242 4242 4242")[0] and "credit_card" not in one(spark, policy.pii_kinds, "1234 5678 9012 3456")[0]


def test_redaction_leaves_no_hit(spark):
    text = "mail a.b@c.org, card 4242 4242 4242 4242, ip 10.1.2.3 end"
    got = one(spark, policy.redact, text, None, "")
    assert got[1:] == [None, ""] and policy.scan_pii(got[0]) == [] and got[0].startswith("mail [REDACTED]") and got[0].endswith(" end")


def test_regions(spark):
    assert one(spark, lambda c: policy.region_allowed(c, policy.EU), "de", "US", None) == [True, False, True]
    assert one(spark, lambda c: policy.region_allowed(c, None, ["ru"], True), "RU", "us", None) == [False, True, False]


def test_robots(spark):
    robots = spark.createDataFrame([("http://a.com", "User-agent: *\nDisallow: /x\nCrawl-delay: 3"), ("http://b.com", "<html>")], "origin string, body string")
    req = spark.createDataFrame([("http://a.com/x/1",), ("http://a.com/y",), ("http://b.com/x",), ("http://c.com/",)], "url string")
    got = {r["url"]: (r["allowed"], r["crawl_delay"]) for r in frontier.robots_gate(req, robots).collect()}
    assert got == {"http://a.com/x/1": (False, 3.0), "http://a.com/y": (True, 3.0), "http://b.com/x": (True, None), "http://c.com/": (True, None)}


def test_signals(spark):
    f = lambda html, st=200: spark.range(1).select(signals.block_reason(F.lit(html), F.lit(st))).collect()[0][0]
    assert f("x", 403) == "http-403" and f("x", 503) == "http-503" and f("  ") == "empty-body" and f('<div id="cf-browser-verification">') == "cloudflare" and f("Access Denied") == "generic-block" and f("<p>fine") is None
    assert one(spark, signals.is_thin, "<script>" + "x" * 500 + "</script>hi", "<p>" + "word " * 60) == [True, False]
    assert one(spark, signals.is_shell, '<main id="root"></main>' + "<!-- " + "x" * 700 + " -->") == [True]


RUNS = [("r1", "u", 1.0, '{"data": {"a": 1, "b": null}}', "h1"), ("r2", "u", 2.0, '{"data": {"a": 2, "c": 3}}', "h2"), ("r3", "v", 1.0, "{}", "h1")]


def log(spark):
    df = spark.createDataFrame(RUNS, "run_id string, url string, started_at double, extraction_json string, html_hash string")
    return df.withColumns({"extraction_method": F.lit("metadata"), "model_pinned": F.lit(None).cast("string"), "schema_version": F.lit("s"), "tier_used": F.lit(0)})


def test_history(spark):
    r = log(spark)
    assert {x["run_id"] for x in runs.latest(r).collect()} == {"r2", "r3"}
    assert [x["run_id"] for x in runs.listing(r, 2).collect()] == ["r2", "r1"]
    d = runs.diff_text(runs.diff_latest(r)).collect()
    assert len(d) == 1 and [(c["field"], c["before"], c["after"]) for c in d[0]["field_changes"]] == [("a", "1", "2"), ("c", None, "3")]
    assert d[0]["same_html"] is False and d[0]["same_method"] and "~ a: 1 -> 2" in d[0]["summary"]
    req = spark.createDataFrame([("u", 1.5), ("u", 0.5), ("u", 9.0), ("w", 1.0)], "url string, at double")
    got = {(x["url"], x["at"]): x["run"] and x["run"]["run_id"] for x in runs.as_of(req, r).collect()}
    assert got == {("u", 1.5): "r1", ("u", 0.5): None, ("u", 9.0): "r2", ("w", 1.0): None}
    assert runs.changed_only(spark.createDataFrame([("u", "x")], "url string, html string"), r).count() == 1


def test_queue_and_rules(spark):
    e = spark.createDataFrame([("c", "a", "enqueue", 1), ("c", "a", "claim", 2), ("c", "a", "fail", 3), ("c", "b", "enqueue", 1), ("c", "b", "claim", 2), ("c", "b", "complete", 3), ("c", "d", "claim", 1), ("c", "d", "fail", 2), ("c", "d", "claim", 3), ("c", "d", "fail", 4)], "crawl_id string, url string, event string, at int")
    assert {r["url"]: r["status"] for r in runs.queue_state(e).collect()} == {"a": "pending", "b": "done", "d": "failed"}
    k = ("h", "p", "s", "f")
    ev = spark.createDataFrame([(*k, "h1", "learn", 1), (*k, None, "fail", 2), (*k, None, "fail", 3), ("h2", *k[1:], "x", "learn", 1), *[("h2", *k[1:], None, "fail", t) for t in (2, 3, 4)]], "host string, path_template string, schema_hash string, field_name string, selector string, event string, at int")
    rules = runs.selector_rules(ev).collect()
    assert [(r["host"], r["selector"], r["failure_count"]) for r in rules] == [("h", "h1", 2)]


SITE = [("http://s.com/", '<a href="/a">1</a><a href="/b#x">2</a><a href="http://o.com/">3</a><a href="/f.pdf">4</a>'), ("http://s.com/a", '<link rel=next href="/a2"><a href="/c">5</a>'), ("http://s.com/a2", '<a href="/">6</a>'), ("http://s.com/c", '<a href="/d">7</a>')]


def test_crawl(spark):
    pages = spark.createDataFrame(SITE, "url string, html string")
    seeds = spark.createDataFrame([("http://www.s.com/".replace("www.", ""),)], "url string")
    got = {r["url"]: (r["depth"], r["status"]) for r in frontier.crawl(pages, seeds, 2).collect()}
    assert got == {"http://s.com/": (0, "done"), "http://s.com/a": (1, "done"), "http://s.com/b": (1, "failed"), "http://s.com/a2": (1, "done"), "http://s.com/c": (2, "done")}
    assert [r["url"] for r in frontier.map_site(pages, seeds, max_urls=2).collect()] == ["http://s.com/", "http://s.com/a"]


def test_sitemaps(spark):
    import gzip

    ns = 'xmlns="urn:maps"'
    files = spark.createDataFrame(
        [("i", bytearray(f"<sitemapindex {ns}><sitemap><loc>m1</loc></sitemap><sitemap><loc>m2</loc></sitemap></sitemapindex>".encode())), ("m1", bytearray(gzip.compress(f"<urlset {ns}><url><loc> http://x/1 </loc></url></urlset>".encode()))), ("m2", bytearray(b"broken"))],
        "url string, body binary",
    )
    assert [r[0] for r in frontier.sitemap_urls(files, spark.createDataFrame([("i",)], "url string")).collect()] == ["http://x/1"]


def test_scrape_and_batch(spark):
    pages = spark.createDataFrame([("http://a.com/", "<title>T</title><p>mail x@y.org now, this is text</p>", 200), ("http://b.com/", "denied", 403), ("http://127.0.0.1/", "<p>x", 200)], "url string, html string, status int")
    rows = {r["url"]: r for r in api.scrape(pages, redact=True).collect()}
    assert rows["http://a.com/"]["pii_kinds"] == ["email"] and "[REDACTED]" in rows["http://a.com/"]["markdown"] and rows["http://a.com/"]["chunks"][0]["text"].startswith("mail [REDACTED]")
    assert rows["http://b.com/"]["block_reason"] == "http-403" and rows["http://127.0.0.1/"]["block_reason"] == "ssrf" and rows["http://127.0.0.1/"]["markdown"] is None
    want = spark.createDataFrame([(0, "http://a.com/"), (1, "http://zz.com/"), (2, "http://a.com/")], "pos int, url string")
    got = api.batch_scrape(want, pages).collect()
    assert [r["url"] for r in got] == ["http://a.com/", "http://zz.com/", "http://a.com/"] and got[1]["error"] == "not fetched"


def test_exports(spark, tmp_path):
    r = spark.createDataFrame([("u", "r", '{"b": {"x": 1}, "a": "q", "url": "no"}', None), ("v", None, None, "boom")], "url string, run_id string, extraction_json string, error string")
    lines = [json.loads(x["value"]) for x in export.json_lines(r).collect()]
    assert lines[1] == {"url": "v", "error": "boom"} and lines[0]["run_id"] == "r"
    export.to_csv(r, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == [*export.BASE, "a", "b"] and {x["url"]: x["b"] for x in back.collect()}["v"] is None


def test_state_tables(spark, tmp_path):
    p = str(tmp_path / "log")
    state.append(spark.createDataFrame([("r1", 1)], "run_id string, n int"), p)
    state.append(spark.createDataFrame([("r2", 2, "x")], "run_id string, n int, extra string"), p)
    assert state.log(spark, p).count() == 2 and "extra" in state.log(spark, p).columns
    a = str(tmp_path / "audit")
    state.audit_append(spark.createDataFrame([(1.0, "a"), (2.0, "b")], "ts double, event string"), a)
    (tmp_path / "audit" / "bad.txt").write_text("{oops\n")
    assert [r["event"] for r in state.audit_tail(spark, a, "ts double, event string", 1).collect()] == ["b"]


def test_watch(spark, tmp_path):
    w = spark.createDataFrame([("1", "u", 10.0, True, None, None, None, 0.0), ("2", "v", 10.0, True, "r", 95.0, None, 1.0), ("3", "w", 1.0, False, None, None, None, 2.0)], "id string, url string, interval_seconds double, enabled boolean, last_run_id string, last_checked_at double, last_changed_at double, created_at double")
    assert [r["id"] for r in runs.watch_due(w, F.lit(100.0)).collect()] == ["1"]
    moved, out = watch.tick(w, lambda due: due.select("id", F.lit("n").alias("run_id"), F.lit(True).alias("changed"), F.lit(None).cast("string").alias("error")), 100.0)
    row = {r["id"]: r for r in moved.collect()}["1"]
    assert (row["last_run_id"], row["last_checked_at"], row["last_changed_at"]) == ("n", 100.0, 100.0)


def test_change_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("u", "a", 1.0, "1", False), ("u", "b", 2.0, "2", False), ("u", None, 3.0, "3", True), ("v", "x", 1.0, "4", False)], "url string, html string, at double, run_id string, not_modified boolean").write.parquet(src)
    feed = watch.changes(watch.page_stream(spark, src, "url string, html string, at double, run_id string, not_modified boolean"))
    seen = []
    watch.on_change(feed, lambda df, n: seen.extend((r["url"], r["run_id"]) for r in df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert seen == [("u", "2")]


def test_registered_map_site_keeps_every_host(spark, tmp_path):
    from weftline.plans import queries

    links = "".join(f'<a href="/p{k}">x</a>' for k in range(5100))
    rows = [(1, "http://a.com/", f"<html><body>{links}</body></html>"), (2, "http://z.com/", "<html><body>last</body></html>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["url"] for r in queries.map_site(spark, str(tmp_path)).collect()}
    assert len(got) == 5102 and "http://z.com/" in got


def test_claims_are_first_in_first_out(spark):
    q = spark.createDataFrame([(3, "pending", 0, None), (1, "done", 1, 1.0), (2, "pending", 1, None), (4, "pending", 0, None), (5, None, None, None)], "id bigint, status string, attempts int, claimed_at double")
    got = {r["id"]: (r["status"], r["attempts"], r["claimed_at"]) for r in runs.claim(q, 2, 9.0).collect()}
    assert got == {1: ("done", 1, 1.0), 2: ("in_flight", 2, 9.0), 3: ("in_flight", 1, 9.0), 4: ("pending", 0, None), 5: (None, None, None)}
    assert runs.claim(q.limit(0), 2, 9.0).count() == 0 and runs.claim(q, 0, 9.0).where("status = 'in_flight'").count() == 0


def test_tiers(spark):
    body = "<p>" + "many words of a good page " * 20
    tries = spark.createDataFrame([("a", 0, "", 403), ("a", 1, body, 200), ("a", 2, body, 200), ("b", 0, "", 500), ("b", 2, None, 403)], "url string, tier int, html string, status int")
    assert {r["url"]: (r["tier"], r["tried"]) for r in api.chosen_tier(tries).collect()} == {"a": (1, 2), "b": (2, 2)}
    path = lambda a, b: spark.range(1).select(signals.escalation_path(F.lit(a), F.lit(b)).alias("p")).first()["p"]
    assert path(0, 2) == [0, 1, 2] and path(3, 9) == [3, 4] and path(2, 1) == []


def test_budget_over_all_rows(spark):
    rows = spark.createDataFrame([(k, 1.0 if k % 3 else None) for k in range(200)], "k int, cost double").repartition(7)
    got = sorted((r["k"], r["spent_before"]) for r in runs.budget_prefix(rows, ["k"], "cost", 20.0).collect())
    want, spent = [], 0.0
    for k in range(200):
        if spent < 20:
            want.append((k, spent))
        spent += 1.0 if k % 3 else 0.0
    assert got == want and runs.budget_prefix(rows.limit(0), ["k"], "cost", 20.0).count() == 0


def test_field_changes_in_the_stream(spark, tmp_path):
    src, kind = str(tmp_path / "in"), "url string, html string, at double, run_id string, not_modified boolean, data string"
    rows = [("u", "a", 1.0, "1", False, '{"price": "1", "name": "n"}'), ("u", "a", 2.0, "2", False, '{"price": "2", "name": "n"}'), ("u", "a", 3.0, "3", False, '{"price": "2", "name": "n", "gone": null}'), ("u", None, 4.0, "4", True, None), ("u", "b", 5.0, "5", False, "not json")]
    spark.createDataFrame(rows, kind).write.parquet(src)
    seen = {}
    feed = watch.changes(watch.page_stream(spark, src, kind))
    watch.on_change(feed, lambda df, n: seen.update({r["run_id"]: [tuple(f) for f in r["field_changes"]] for r in df.collect()}), str(tmp_path / "ck")).awaitTermination(120)
    assert seen == {"2": [("price", "1", "2")], "5": [("name", "n", None), ("price", "2", None)]}
    batch = watch.batch_changes(spark.createDataFrame(rows[:3], kind)).where("changed").collect()
    assert [(r["run_id"], [tuple(f) for f in r["field_changes"]]) for r in batch] == [("2", [("price", "1", "2")])]


def test_levels_are_handed_on_and_errors_do_not_stop_the_crawl(spark):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = spark.createDataFrame([("http://a.com/", link("/1", "/2")), ("http://a.com/1", link("/3")), ("http://a.com/3", "")], "url string, html string")
    seen = []

    def on_level(number, level):
        seen.append((number, sorted(r["url"] for r in level.collect())))
        raise ValueError

    queue = frontier.crawl_levels(pages, pages.where("url = 'http://a.com/'"), 2, on_level)
    assert seen == [(0, ["http://a.com/"]), (1, ["http://a.com/1", "http://a.com/2"]), (2, ["http://a.com/3"])] and queue.count() == 4
