"""Parsers, graph rounds and keyed state against plain versions."""

import gzip
import random
from datetime import datetime, timedelta

from lodestar.operators import graph
from lodestar.sources import html, records
from lodestar.streaming import state


def test_robots():
    rules = records.robots_rules("User-agent: *\nDisallow: /x\nUser-agent: Own\nUser-agent: Two\nDisallow: /private\nAllow: /private/open*\nCrawl-delay: 2\nSitemap: https://h/s.xml", "own/1.0")
    assert ("sitemap", "https://h/s.xml") in rules and ("delay", "2") in rules
    assert records.allowed(rules, "/x") and not records.allowed(rules, "/private/a") and records.allowed(rules, "/private/open1")
    assert not records.allowed([("disallow", "/*.pdf$")], "/a.pdf") and records.allowed([("disallow", "/*.pdf$")], "/a.pdfx")


def test_archive():
    body = b"4\r\n<p>a\r\n3\r\n</p\r\n1\r\n>\r\n0\r\n\r\n"
    assert records.dechunk(body) == b"<p>a</p>" and records.dechunk(b"plain") == b"plain"
    head = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    assert records.archive_response(gzip.compress(head + b"Transfer-Encoding: chunked\r\n\r\n" + body)) == ("text/html", "<p>a</p>")
    assert records.archive_response(gzip.compress(head + b"X-Robots-Tag: noindex\r\n\r\nx")) is None
    assert records.archive_response(gzip.compress(head + b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(b"<i>"))) == ("text/html", "<i>")
    assert records.archive_response(b"junk") is None


def test_wikitext():
    text = "A{{t|{{u}}}} '''b''' [[C|d]] [[E]]<ref>r</ref>\n== H ==\n* i <!-- c -->{|\n|x\n|}"
    assert records.wikitext(text) == "A b d E\nH\ni"
    assert records.wiki_links("[[A|x]] [[File:y]] [[B#s]] [[A]]") == ["A", "B"]


def test_html():
    page = html.extract("<html lang=de-DE><title>T &amp; u</title><meta name=robots content=noindex><nav>no</nav><h1>Head<p>one <a href='/x' rel=nofollow>li nk</a><script>'</p>'</script> two<img src=i.png alt=z>", "https://h/a/")
    assert page["title"] == "T & u" and page["language"] == "de" and page["robots"] == "noindex"
    assert page["links"] == [{"url": "https://h/x", "anchor": "li nk", "nofollow": True}]
    assert page["media"] == [{"url": "https://h/a/i.png", "type": "image", "alt": "z"}] and "no" not in page["text"].split()
    assert html.extract(None, None)["text"] == ""


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2, "b": "x"}\n')
    assert sorted(r["a"] for r in records.json_lines(spark, str(tmp_path), "a long, b string").collect()) == [1, 2]
    xml = spark.createDataFrame([("<urlset><url><loc>u</loc></url><url><loc> v </loc><priority>0.9</priority><changefreq>daily</changefreq></url></urlset>",)], "value string")
    assert [tuple(r) for r in records.sitemap(xml).collect()] == [("u", "", 0.5, "weekly"), ("v", "", 0.9, "daily")]


def test_first_seen(spark):
    r = random.Random(3)
    for _ in range(3):
        pairs = {tuple(sorted(r.sample(range(30), 2))) for _ in range(40)}
        kept = []
        for i in range(30):
            if not any((k, i) in pairs for k in kept):
                kept.append(i)
        got = graph.first_seen(spark.range(30), spark.createDataFrame(list(pairs), "a long, b long"))
        assert sorted(x["id"] for x in got.collect()) == kept


def test_pagerank(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 3), (5, 5), (3, 6)], "src long, dst long")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == 3 and set(ranks) == {1, 2, 3, 4, 5, 6}
    assert graph.pagerank(edges.limit(0)).count() == 0


def test_rate_limit(spark, tmp_path):
    t = datetime(2024, 1, 1)
    r = random.Random(1)
    at = sorted(r.randrange(400) for _ in range(60))
    rows = [(i, 7, t + timedelta(seconds=s)) for i, s in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {x["event_id"]: x["allowed"] for x in state.drain(state.rate_limit(state.events_stream(spark, str(tmp_path)), limit=5), "append").collect()}
    start, n, want = -1e9, 0, {}
    for i, s in enumerate(at):
        if s - start >= 60:
            start, n = s, 0
        n += 1
        want[i] = n <= 5
    assert got == want


def test_drained_to_files(spark):
    """Rows of a stream stay off the driver, in either mode."""
    from lodestar.plans import registry

    for name in ("stm_1", "stm_3", "stm_5"):
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "parquet" in plan and "Memory" not in plan, plan
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert df.count() == events.count() == registry.queries()["stm_3"](spark, "/root/testdata/sf0.001").count()


def test_rate_limit_of_a_hot_user(spark, tmp_path):
    """More rows of a key than a frame holds, in no order."""
    t, r = datetime(2024, 1, 1), random.Random(2)
    at = {i: r.randrange(30_000) for i in range(25_000)}
    rows = [(i, 7, t + timedelta(seconds=s)) for i, s in at.items()]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {x["event_id"]: x["allowed"] for x in state.drain(state.rate_limit(state.events_stream(spark, str(tmp_path)), limit=40), "append").collect()}
    start, n, want = -1e9, 0, {}
    for i, s in sorted(at.items(), key=lambda x: (x[1], x[0])):
        if s - start >= 60:
            start, n = s, 0
        n += 1
        want[i] = n <= 40
    assert got == want and 100 < sum(want.values()) < 24_900


def test_python_sees_pieces(spark):
    """However large a batch is, objects are made of about a megabyte at a time, and links alone leave the worker where links are asked for."""
    from pyspark.sql import functions as F

    from lodestar.functions.batches import PIECE, column

    sizes = column(lambda texts: [sum(map(len, texts))] * len(texts), "long")
    got = spark.range(0, 3000, 1, 1).select(sizes(F.repeat(F.lit("abcde"), 1000)).alias("n")).agg(F.max("n"), F.count("*")).first()
    assert got[0] <= 1.1 * PIECE and got[1] == 3000
    assert spark.range(0).select(sizes(F.lit("x")).alias("n")).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, bytearray(b"3\r\nabc\r\n0\r\n\r\n"))], "id long, b binary")
    assert {x["id"]: x["d"] for x in nulls.select("id", records.dechunked(F.col("b")).alias("d")).collect()} == {1: None, 2: bytearray(b"abc")}
    links = html.backlinks(spark.createDataFrame([("https://h/a", "<p>t<a href='/x'>y</a>"), ("https://h/b", None)], "url string, html string"))
    assert [tuple(x) for x in links.collect()] == [("https://h/a", "https://h/x", "y", False, True)] and "word_count" not in links._jdf.queryExecution().analyzed().toString()
