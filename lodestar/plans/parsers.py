"""Queries over captured texts, made from the driver's tables so that what must come out is known; the SQL says that, not how it is parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.batches import column
from lodestar.operators import queries
from lodestar.operators.lexicon import SERVING_SPELLING, SPELLING
from lodestar.plans.tables import Tables, m, micro, with_views
from lodestar.sources import feeds, providers, records, structured

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def _words(n: int = 1):
    """The n-th lower-case word of an item's text."""
    # only as far as that word; possessive, so that no word is cut to make more of them
    return F.coalesce(F.nullif(F.regexp_extract(F.lower("content"), f"^(?:[^a-z]*+[a-z]++){{{n - 1}}}[^a-z]*+([a-z]+)", 1), F.lit("")), F.lit("x"))


W = "coalesce(regexp_extract_all(lower(content), '[a-z]+')[{}], 'x')"
RAW = lambda: F.concat(_words(1), F.lit(' "'), _words(2), F.lit(" "), _words(3), F.lit('" -'), _words(4), F.lit(" SITE:www."), F.col("source_name"), F.lit(".example/ after:2021 after:soon before:2023-02 filetype:.PDF "), _words(5))


@query("str_17", f"SELECT id, concat({W.format(2)}, ' ', {W.format(3)}) AS phrases, {W.format(4)} AS exclude, concat({W.format(1)}, '|after:soon|', {W.format(5)}) AS terms, concat(source_name, '.example') AS site, 'pdf' AS filetype, '2021-01-01' AS after, '2023-02-31' AS before, concat({W.format(2)}, ' ', {W.format(3)}, ' ', {W.format(1)}, ' after:soon ', {W.format(5)}) AS cleaned, TRUE AS active FROM items")
def _(t):
    r = t.items.select("id", queries.parse(RAW()).alias("o")).select("id", "o.*")
    return r.withColumns({c: F.array_join(c, "|") for c in ("phrases", "exclude", "terms")})


@query("str_19", f"SELECT id, concat('site:', source_name, '.example filetype:pdf \"', {W.format(2)}, ' ', {W.format(3)}, '\" -', {W.format(4)}, ' after:2021-01-01 before:2023-02-31') AS chips FROM items")
def _(t):
    return t.items.select("id", F.array_join(queries.chips(queries.parse(RAW())), " ").alias("chips"))


@query("str_18", "SELECT id, CASE id % 4 WHEN 0 THEN '2021-01-01' WHEN 1 THEN '2021-03-01' WHEN 2 THEN '2021-03-04' ELSE '' END AS low, CASE id % 4 WHEN 0 THEN '2021-12-31' WHEN 1 THEN '2021-03-31' WHEN 2 THEN '2021-03-04' ELSE '' END AS high FROM items")
def _(t):
    raw = F.when(F.col("id") % 4 == 0, " 2021").when(F.col("id") % 4 == 1, "2021-03").when(F.col("id") % 4 == 2, "2021-03-04").otherwise("March")
    return t.items.select("id", queries.whole_date(raw, False).alias("low"), queries.whole_date(raw, True).alias("high"))


def _values(table: dict[str, str]) -> str:
    rows = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(table.items()))
    return f"k AS (SELECT * FROM (VALUES {rows}) x(word, fixed, pos)), known AS (SELECT fixed, min(pos) AS pos FROM k GROUP BY fixed)"


TYPOS = [k for k in SPELLING if " " not in k]
TEXT = lambda: F.concat_ws(" ", _words(1), F.element_at(F.array(*[F.lit(k) for k in TYPOS]), (F.col("id") % len(TYPOS) + 1).cast("int")), _words(2), F.lit("mathematik pysics"))
TEXT_SQL = f"concat_ws(' ', {W.format(1)}, ([{', '.join(repr(k) for k in TYPOS)}])[(id % {len(TYPOS)} + 1)::INT], {W.format(2)}, 'mathematik pysics')"
FIX = """w AS (SELECT id, unnest(string_split(q, ' ')) AS w, unnest(range(len(string_split(q, ' ')))) AS i FROM q),
f AS (SELECT id, i, w, (SELECT fixed FROM k WHERE word = w) AS direct, (SELECT arg_min(fixed, [levenshtein(w, fixed), pos]) FROM known WHERE levenshtein(w, fixed) <= 2 AND levenshtein(w, fixed) < 0.4 * length(w)) AS near FROM w),
c AS (SELECT id, string_agg(coalesce(direct, CASE WHEN length(w) > 3 THEN near END, w), ' ' ORDER BY i) AS fixed, string_agg(w, ' ' ORDER BY i) AS plain FROM f GROUP BY id)"""


@query("str_9", f"WITH {_values(SPELLING)}, q AS (SELECT id, {TEXT_SQL} AS q FROM items), {FIX} SELECT id, fixed FROM c")
def _(t):
    return t.items.select("id", F.array_join(queries.correct_words(F.split(TEXT(), " ")), " ").alias("fixed"))


PAIRS = "CASE id % 4 WHEN 0 THEN 'about Machine  lerning now' WHEN 1 THEN 'quantum mechancis' WHEN 2 THEN 'pythn' ELSE 'pythn rocks' END"
PAIR = lambda: F.when(F.col("id") % 4 == 0, "about Machine  lerning now").when(F.col("id") % 4 == 1, "quantum mechancis").when(F.col("id") % 4 == 2, "pythn").otherwise("pythn rocks")


@query("str_10", "SELECT id, CASE id % 4 WHEN 0 THEN 'about machine learning now' WHEN 1 THEN 'quantum mechanics' WHEN 2 THEN 'python' END AS fixed FROM items")
def _(t):
    return t.items.select("id", queries.exact_correction(PAIR()).alias("fixed"))


@query("str_11", f"WITH {_values(SERVING_SPELLING)}, q AS (SELECT id, lower({TEXT_SQL}) AS q FROM items), {FIX} SELECT id, CASE WHEN fixed <> plain THEN fixed END AS better FROM c")
def _(t):
    return t.items.select("id", queries.did_you_mean(TEXT()).alias("better"))


@query("rem_19", f"SELECT id, concat({W.format(1)}, 'en ', {W.format(1)}, 's') AS added FROM items")
def _(t):
    tokens = F.array(_words(1))
    expanded = F.array(_words(1), F.concat(_words(1), F.lit("en")), F.concat(_words(1), F.lit("s")))
    return t.items.select("id", F.array_join(queries.interpretation(expanded, tokens), " ").alias("added"))


# lines and records
@query("src_1", "SELECT id, title FROM items WHERE id % 5 < 3")
def _(t):
    line = F.when(F.col("id") % 5 < 3, F.to_json(F.struct("id", "title"))).when(F.col("id") % 5 == 3, "").otherwise("{broken")
    place = t.place("lines")
    t.items.select(line.alias("value")).write.text(place)
    return records.json_lines(t.spark, place, "id long, title string")


@query("src_2", "SELECT id, CASE WHEN id % 2 = 0 THEN 'crawled_a.jsonl' ELSE 'crawled_b.jsonl' END AS file FROM items WHERE id % 4 < 2")
def _(t):
    place = t.place("files")
    for k, name in enumerate(("crawled_a.jsonl", "crawled_b.jsonl", "other.jsonl")):
        t.items.where(F.col("id") % 4 == k).select(F.to_json(F.struct("id")).alias("value")).write.text(f"{place}/{name}")
    rows = t.spark.read.schema("id long").option("recursiveFileLookup", "true").json(f"{place}/crawled_*.jsonl")
    return rows.select("id", F.regexp_extract("_metadata.file_path", r"/(crawled_\w\.jsonl)/", 1).alias("file"))


CDX_LINE = lambda: F.to_json(F.struct(F.concat(F.lit("com,x)/"), F.col("id") % 50).alias("urlkey"), F.col("url"), F.lpad(F.col("id").cast("string"), 14, "0").alias("timestamp"), F.when(F.col("id") % 3 == 0, "TEXT/HTML").otherwise("text/html").alias("mime"), F.when(F.col("id") % 7 == 0, "404").otherwise("200").alias("status"), F.lit("f.gz").alias("filename"), F.col("id").cast("string").alias("offset"), (F.col("id") * 5000).cast("string").alias("length")))


@query("src_7", "SELECT concat('com,x)/', id % 50) AS urlkey, min(id) AS id FROM items WHERE id % 7 <> 0 GROUP BY 1")
def _(t):
    rows = t.items.select(F.from_json(CDX_LINE(), records.CDX + ", urlkey string").alias("r")).select("r.*")
    return records.discovered(rows).select("urlkey", F.col("offset").cast("long").alias("id"))


@query("src_10", "SELECT id FROM items WHERE id > 0 AND id * 5000 <= 2000000")
def _(t):
    return records.fetchable(records.cdx(t.items.select(CDX_LINE().alias("value")))).select(F.col("offset").alias("id"))


@query("src_12", "SELECT id, title FROM items ORDER BY id LIMIT 100")
def _(t):
    place = t.place("index")
    t.items.select(F.concat_ws(":", F.lpad(F.col("id").cast("string"), 9, "0"), F.col("id"), "title").alias("value")).repartition(3).write.text(place)
    lines = t.spark.read.text(place).orderBy("value").limit(100)
    return records.index_lines(lines).select(F.col("page_id").alias("id"), "title")


def _warc(kind: str, head: str):
    body = F.encode(F.concat(F.lit("<html>"), F.col("content"), F.lit("</html>")), "UTF-8")
    chunked = F.concat(F.encode(F.concat(F.hex(F.length(body)), F.lit("\r\n")), "UTF-8"), body, F.encode(F.lit("\r\n0\r\n\r\n"), "UTF-8"))
    top = F.encode(F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{head}"), "UTF-8")
    return top, body, chunked


@query("src_8", "SELECT id, CASE WHEN id % 4 < 2 THEN md5(concat('<html>', content, '</html>')) END AS html FROM items")
def _(t):
    top, body, chunked = _warc("response", "")
    chunked_top = F.concat(top, F.encode(F.lit("Transfer-Encoding: chunked\r\n\r\n"), "UTF-8"))
    record = F.when(F.col("id") % 4 == 0, F.concat(top, F.encode(F.lit("\r\n"), "UTF-8"), body)).when(F.col("id") % 4 == 1, F.concat(chunked_top, chunked))
    record = record.when(F.col("id") % 4 == 2, F.concat(top, F.encode(F.lit("X-Robots-Tag: noindex\r\n\r\n"), "UTF-8"), body)).otherwise(F.encode(F.lit("\x1fÿ broken"), "ISO-8859-1"))
    return records.responses(t.items.select("id", record.alias("record")), "record", ["id"]).select("id", F.md5("html").alias("html"))


@query("src_9", "SELECT id, md5(concat('<html>', content, '</html>')) AS body FROM items")
def _(t):
    _, body, chunked = _warc("response", "")
    return t.items.select("id", F.md5(records.dechunked(F.when(F.col("id") % 3 == 0, body).otherwise(chunked))).alias("body"))


ROBOTS = lambda: F.concat(F.lit("# all\nUser-agent: *\nDisallow: /a\nAllow: /a/b$\nDisallow: /*.pdf\nUser-agent: bot\nUser-agent: mine\nDisallow: /private\nCrawl-delay: 2\nSitemap: https://"), F.col("host"), F.lit("/s.xml\n"))


@query("src_25", "WITH h AS (SELECT DISTINCT source_name AS host FROM items) SELECT host, 'disallow' AS kind, '/private' AS value FROM h UNION ALL SELECT host, 'delay', '2' FROM h UNION ALL SELECT host, 'sitemap', concat('https://', host, '/s.xml') FROM h")
def _(t):
    sites = t.items.select(F.col("source_name").alias("host")).distinct().withColumn("text", ROBOTS())
    return records.robots_table(sites, "mine/1.0")


PATHS = lambda: F.element_at(F.array(*[F.lit(p) for p in ("/a/x", "/a/b", "/a/b/c", "/x.pdf", "/y", "/private")]), (F.col("id") % 6 + 1).cast("int"))


@query("fil_18", "SELECT id, id % 6 IN (1, 4, 5) AS allowed FROM items")
def _(t):
    sites = t.items.select(F.col("source_name").alias("host")).distinct().withColumn("text", ROBOTS())
    return records.may_fetch(t.items.select("id", F.col("source_name").alias("host"), PATHS().alias("path")), sites, "other").select("id", "allowed")


@query("fil_19", "SELECT id, id % 6 IN (3, 4, 5) AS allowed FROM items")
def _(t):
    text = F.lit("User-agent: *\nDisallow: /a\nDisallow:\nUser-agent: mine\nDisallow: /private")
    return t.items.select("id", records.prefix_allowed(text, PATHS()).alias("allowed"))


# feeds
TITLE = lambda: F.regexp_replace("title", "[<>&\\s]+", " ")
TITLE_SQL = "trim(regexp_replace(title, '[<>&\\s]+', ' ', 'g'))"
BODY = lambda: F.regexp_replace("content", "[<>&\\s]+", " ")
BODY_SQL = "trim(regexp_replace(content, '[<>&\\s]+', ' ', 'g'))"
FEED = lambda: F.concat(F.lit("<rss><channel><title>no</title><item><title><![CDATA["), TITLE(), F.lit("]]></title><link>"), F.col("url"), F.lit("</link><pubDate>"), F.col("published"), F.lit("</pubDate><description>"), BODY(), F.lit('</description></item><entry><title>e</title><link rel="x" href="https://e/'), F.col("id"), F.lit('"/><summary>short</summary></entry><item><title>no link</title></item></channel></rss>'))


@query("src_20", f"SELECT id, {TITLE_SQL} AS title, url, published FROM items WHERE {TITLE_SQL} <> '' UNION ALL SELECT id, 'e', concat('https://e/', id), '' FROM items")
def _(t):
    return feeds.feed_items(t.items.select("id", FEED().alias("xml")), "xml", ["id"]).select("id", "title", "url", "published")


@query("rem_21", f"SELECT id, {TITLE_SQL} AS title FROM items")
def _(t):
    return t.items.select("id", feeds.plain(feeds.tag(F.concat(F.lit("<title>"), TITLE(), F.lit("</title>")), "title")).alias("title"))


@query("src_18", f"SELECT url, {TITLE_SQL} AS title, sha256(substr({BODY_SQL}, 1, 45000)) AS content_hash, published FROM items WHERE {TITLE_SQL} <> '' AND length({BODY_SQL}) >= 20")
def _(t):
    items = feeds.feed_items(t.items.select("id", FEED().alias("xml")), "xml", ["id"])
    return feeds.crawl_records(items, "feed", "news").select("url", "title", "content_hash", "published")


@query("con_6", f"SELECT id, {m('(contains(lower(' + TITLE_SQL + '), ' + chr(39) + 'the' + chr(39) + ')::INT + 1) / 2')} AS match FROM items WHERE {TITLE_SQL} <> '' AND contains(lower({TITLE_SQL}), 'e')")
def _(t):
    items = t.items.select("id", TITLE().alias("title"), F.lit("").alias("snippet")).withColumn("title", F.trim("title")).where("title <> ''")
    return feeds.search_feed(items, ["the", "E"]).where(F.lower("title").contains("e")).select("id", micro(F.col("match")).alias("match"))


SITE = lambda: F.concat(F.lit("<urlset><url><loc> "), F.col("url"), F.lit(" </loc><priority>"), F.when(F.col("id") % 2 == 0, "0.8").otherwise(""), F.lit("</priority></url><url><loc>https://x/"), F.col("id") % 7, F.lit("</loc><lastmod>2024-01-01</lastmod><changefreq>daily</changefreq></url></urlset>"))


@query("src_23", f"SELECT id, url, {m('CASE WHEN id % 2 = 0 THEN 0.8 ELSE 0.5 END')} AS priority, 'weekly' AS changefreq FROM items UNION ALL SELECT id, concat('https://x/', id % 7), 500000, 'daily' FROM items")
def _(t):
    return t.items.select("id", F.inline(feeds.sitemap_entries(SITE()))).select("id", "url", micro(F.col("priority")).alias("priority"), "changefreq")


@query("src_24", "WITH e AS (SELECT source_name AS host, url FROM items WHERE id < 10 UNION SELECT source_name, concat('https://x/', id % 7) FROM items WHERE id < 10) SELECT host, url FROM e")
def _(t):
    few = t.items.where("id < 10")
    files = few.select(F.concat(F.lit("https://m/"), F.col("id")).alias("url"), SITE().alias("xml"))
    index = lambda name, locs: F.concat(F.lit(f"<sitemapindex>{name}"), F.array_join(F.transform(locs, lambda x: F.concat(F.lit("<sitemap><loc>"), x, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>"))
    by = few.groupBy("source_name").agg(F.array_sort(F.collect_list(F.concat(F.lit("https://m/"), F.col("id")))).alias("locs"))
    middle = by.select(F.concat(F.lit("https://i/"), "source_name").alias("url"), index("", F.col("locs")).alias("xml"))
    top = by.select(F.concat(F.lit("https://t/"), "source_name").alias("url"), index("", F.array(F.concat(F.lit("https://i/"), "source_name"))).alias("xml"))
    roots = by.select(F.col("source_name").alias("host"), F.concat(F.lit("https://t/"), "source_name").alias("url"))
    return feeds.sitemap_tree(files.unionByName(middle).unionByName(top), roots).select("host", "url")


# wiki
PAGE = lambda: F.concat(
    F.lit("<page><title>"), F.concat(F.lit("T &amp; "), F.col("id")), F.lit("</title><ns>"), F.when(F.col("id") % 5 == 0, "4").otherwise("0"), F.lit("</ns><id>"), F.col("id"), F.lit("</id>"),
    F.when(F.col("id") % 5 == 1, '<redirect title="x" />').otherwise(""), F.lit("<revision><id>9</id><timestamp>2024-02-03T04:05:06Z</timestamp><text bytes=\"1\""), F.when(F.col("id") % 5 == 2, ' deleted="deleted"').otherwise(""),
    F.lit(">'''Bold''' [["), F.col("source_name"), F.lit("|label]] {{t|{{u}}}} &lt;ref&gt;gone&lt;/ref&gt;"), BODY(), F.lit("</text></revision></page><page><title>cut"),
)


@query("src_14", "SELECT id::VARCHAR AS page_id, concat('T & ', id) AS title, '2024-02-03T04:05:06Z' AS revised FROM items WHERE id % 5 > 2")
def _(t):
    return feeds.wiki_pages(t.items.select(PAGE().alias("xml")), "xml", []).select("page_id", "title", "revised")


@query("src_15", f"SELECT id::VARCHAR AS page_id, concat('https://en.wikipedia.org/wiki/T_%26_', id) AS url, source_name AS links, '2024-02-03' AS published FROM items WHERE id % 5 > 2 AND length(concat('Bold label ', {BODY_SQL})) >= 260")
def _(t):
    made = feeds.wiki_records(feeds.wiki_pages(t.items.select(PAGE().alias("xml")), "xml", []), least=200)
    long = made.where(F.length("content") >= 260)
    return long.select("page_id", "url", F.array_join("links", " ").alias("links"), "published")


@query("str_24", "SELECT id, concat('Bold label gone? ', source_name, ' end') AS text FROM items")
def _(t):
    markup = F.concat(F.lit("<!-- c -->'''Bold''' [[x|label]] <ref>no</ref>gone? [[File:a|[[b]] c]]{{t|{{u}}}}{| class=x\n| y\n|}[["), F.col("source_name"), F.lit("]] __TOC__<math>z</math>end"))
    return t.items.select("id", column(lambda s: [records.wikitext(x) for x in s], "string")(markup).alias("text"))


@query("str_25", "SELECT id, concat(source_name, '|Other page') AS links FROM items")
def _(t):
    markup = F.concat(F.lit("[["), F.col("source_name"), F.lit("|x]] [[File:a]] [[Other page#part]] [["), F.col("source_name"), F.lit("]]"))
    return t.items.select("id", F.array_join(column(lambda s: [records.wiki_links(x) for x in s], "array<string>")(markup), "|").alias("links"))


@query("src_33", "SELECT id, md5(trim(substr(content, 1, 100))) AS digest FROM items WHERE length(content) >= 100 AND NOT contains(content, '  ') AND NOT contains(substr(content, 1, 100), chr(10)) AND NOT contains(content, '[')")
def _(t):
    rows = t.items.where("length(content) >= 100 AND NOT contains(content, '  ') AND NOT contains(substr(content, 1, 100), chr(10)) AND NOT contains(content, '[')")
    return rows.select("id", F.md5(feeds.clean_extract(F.concat(F.trim(F.substring("content", 1, 100)), F.lit("[12][edit]   "))), ).alias("digest"))


@query("src_34", "SELECT id, concat('a b', repeat('c', 30), chr(10), chr(10), source_name) AS text FROM items")
def _(t):
    raw = F.concat(F.lit("a[1]  b"), F.repeat(F.lit("c"), 30), F.lit("[edit]\n\n== Head ==\n\n"), F.col("source_name"), F.lit(" "), F.repeat(F.lit("z"), 40))
    return t.items.select("id", feeds.clean_extract(raw, 60).alias("text"))


REPO = lambda: F.to_json(F.struct(F.concat(F.lit("o/r"), F.col("id")).alias("full_name"), F.when(F.col("id") % 9 > 0, F.col("url")).alias("html_url"), F.lit(" text ").alias("description"), F.array(F.lit("a"), F.lit("b")).alias("topics"), (F.col("id") * 700).alias("stargazers_count"), F.struct(F.lit("me").alias("login")).alias("owner"), F.lit("2024-05-06T00:00:00Z").alias("created_at")))


@query("src_21", f"SELECT url, concat('o/r', id) AS title, {m('0.5 + least(0.45, least(id * 700, 50000) / 50000 * 0.45)')} AS authority, {m('greatest(0.7, least(0.95, 0.9 - 0.05 + id * 700 / 100000))')} AS quality, id * 700 AS stars, 'me' AS author, '2024-05-06' AS published FROM items WHERE id % 9 > 0")
def _(t):
    r = feeds.repositories(t.items.select(REPO().alias("j")), "j")
    return r.select("url", "title", micro(F.col("authority")).alias("authority"), micro(F.col("quality")).alias("quality"), "stars", "author", "published")


@query("src_30", "WITH r AS (SELECT source_name, id, row_number() OVER (PARTITION BY source_name ORDER BY id) - 1 AS place FROM items) SELECT source_name AS country, place::INT AS place, concat('t', id) AS title, 3 AS n_news FROM r WHERE place < 4")
def _(t):
    news = F.array(*[F.struct(F.lit(f"n{k}").alias("title"), F.lit("u").alias("url")) for k in range(5)])
    lists = t.items.groupBy("source_name").agg(F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("t"), F.col("id")).alias("title"), news.alias("news")))).alias("l"))
    answer = lists.select(F.to_json(F.create_map("source_name", F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["news"].alias("news"))))).alias("j"))
    return feeds.trends(answer, "j", each=4).select("country", "place", "title", F.size("news").alias("n_news"))


# structured data
LD = lambda: F.concat(
    F.lit('<html><head><meta property="og:title" content="'), F.col("source_name"), F.lit('"><meta name="twitter:card" content="big"><meta name="last-update" content="u"><meta name="author" content="meta author"><script type="application/ld+json">'),
    F.when(F.col("id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct(F.lit("BlogPosting").alias("@type"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("who "), F.col("id"))).alias("author"), F.col("published").alias("datePublished"), F.array(F.struct(F.lit("2019-01-01").alias("dateModified"))).alias("@graph")))),
    F.lit('</script></head><body><div itemscope itemtype="https://schema.org/Thing"></div></body></html>'),
)


@query("jsn_3", "SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS n_schema, source_name AS og_title, 'big' AS card, 'meta author,u' AS metas, 'https://schema.org/Thing' AS kinds FROM items")
def _(t):
    r = t.items.select("id", structured.extract(LD()).alias("f"))
    return r.select("id", F.size("f.schema_org").alias("n_schema"), F.col("f.open_graph.title").alias("og_title"), F.col("f.twitter_card.card").alias("card"), F.array_join(F.array_sort(F.map_values("f.meta_tags")), ",").alias("metas"), F.array_join("f.microdata", ",").alias("kinds"))


@query("jsn_4", "SELECT id, CASE WHEN id % 3 = 1 THEN concat('who ', id) ELSE 'meta author' END AS author, CASE WHEN id % 3 = 0 THEN '' ELSE published END AS published, CASE WHEN id % 3 = 0 THEN 'webpage' ELSE 'blog_post' END AS kind FROM items")
def _(t):
    r = t.items.select("id", structured.extract(LD()).alias("f"))
    f = F.col("f")
    return r.select("id", structured.author(f).alias("author"), structured.published(f).alias("published"), structured.content_type(f).alias("kind"))


@query("dt_9", "SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE concat(published, ',2019-01-01') END AS dates FROM items")
def _(t):
    return t.items.select("id", F.array_join(structured.extract(LD())["dates"], ",").alias("dates"))


@query("dt_2", "SELECT id, CASE WHEN published = '' THEN '2021-03-09' ELSE published END AS day FROM items")
def _(t):
    return t.items.select("id", structured.resolve_date(F.array(F.lit("soon"), F.col("published"), F.lit("2021-13-01"), F.lit("2021/3/9"), F.lit("2020-01-01"))).alias("day"))


DAYS = ["2020-05-06T07:08:09Z", "2021/3/9", "Tue, 04 Jun 2024 10:00:00 GMT", "4 June 2024", "2021-02-32", "2021-00-10", "soon", ""]


@query("dt_1", "SELECT id, (['2020-05-06', '2021-03-09', '2024-06-04', '2024-06-04', '', '', '', ''])[id % 8 + 1] AS day FROM items")
def _(t):
    raw = F.element_at(F.array(*[F.lit(d) for d in DAYS]), (F.col("id") % 8 + 1).cast("int"))
    return t.items.select("id", structured.normal_date(raw).alias("day"))


@query("dt_8", "SELECT id, (['2020-05-06 07:08:09', '2020-05-06 07:08:09', '2021-03-09 00:00:00', '2021-03-09 00:00:00', '2023-06-01 00:00:00', NULL])[id % 6 + 1] AS at FROM items")
def _(t):
    raw = F.element_at(F.array(*[F.lit(d) for d in ("2020-05-06T07:08:09Z", "2020-05-06T07:08:09", "2021/03/09", "09/03/2021", "some day of 2023", "never")]), (F.col("id") % 6 + 1).cast("int"))
    return t.items.select("id", F.date_format(structured.lenient_time(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


MEDIA = lambda: F.when(F.col("id") % 4 == 0, "{}").when(F.col("id") % 4 == 1, "[bad").otherwise(F.to_json(F.array(*[F.struct(F.concat(F.lit(f"u{k}/"), F.col("id")).alias("url"), F.lit(kind).alias("type"), F.lit(20 * k).alias("width")) for k, kind in enumerate(("image", "video", "video_embed", "audio"))])))


@query("jsn_1", "SELECT id, CASE WHEN id % 4 < 2 THEN 0 ELSE 4 END AS n FROM items")
def _(t):
    return t.items.select("id", F.size(structured.media(MEDIA())).alias("n"))


@query("jsn_2", "SELECT id, concat('u', k, '/', id) AS url FROM items, (SELECT unnest([1, 2]) AS k) WHERE id % 4 >= 2".replace("FROM items, (", "FROM items CROSS JOIN ("))
def _(t):
    return t.items.select("id", F.explode(structured.media_of(structured.media(MEDIA()), ["video", "video_embed"], 5)).alias("m")).select("id", "m.url")


@query("jsn_7", "SELECT id, concat('b', id, '.png') AS source, id % 40 >= 32 OR id % 3 = 0 AS kept FROM items")
def _(t):
    srcset = F.concat(F.lit("a.png 1x,  b"), F.col("id"), F.lit(".png 2x "))
    width = F.when(F.col("id") % 3 != 0, (F.col("id") % 40).cast("int"))
    return t.items.select("id", structured.largest_source(srcset).alias("source"), structured.large_enough(width, F.lit(None).cast("int")).alias("kept"))


# providers
def answer(*fields):
    return F.to_json(F.struct(*fields))


@query("con_5", f"SELECT id, url, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, '2024-01-02' AS published FROM (SELECT id, url, {TITLE_SQL} AS title, source_name FROM items) x WHERE source_name IN ('src1', 'src7')".replace("FROM (SELECT id, url, " + TITLE_SQL + " AS title, source_name FROM items) x", "FROM items").replace("trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title", f"{TITLE_SQL} AS title"))
def _(t):
    body = answer(F.array(F.struct("url", TITLE().alias("title"), F.lit("20240102T030405Z").alias("seendate"))).alias("articles"))
    return providers.news(t.items.select("id", body.alias("j")), "j", ["id"], ["src1.example", "src7.example"]).drop("place")


@query("con_7", f"SELECT id, url, concat({W.format(1)}, ' mid ', {W.format(1)}, ' end') AS snippet, published FROM items WHERE {W.format(1)} NOT IN ('mid', 'end')")
def _(t):
    items = t.items.where(~_words(1).isin("mid", "end"))
    index = F.create_map(F.lit("end"), F.array(F.lit(3)), _words(1), F.array(F.lit(2), F.lit(0)), F.lit("mid"), F.array(F.lit(1)))
    body = answer(F.array(F.struct(F.col("url").alias("id"), F.lit("x").alias("display_name"), F.col("published").alias("publication_date"), index.alias("abstract_inverted_index"))).alias("results"))
    return providers.works(items.select("id", body.alias("j")), "j", ["id"]).select("id", "url", "snippet", "published")


@query("con_8", "SELECT id, url, 'A' AS title, concat('Ann ', source_name) AS author, CASE WHEN id % 2 = 0 THEN concat('2020-', lpad((id % 12 + 1)::VARCHAR, 2, '0')) ELSE '2020' END AS published FROM items")
def _(t):
    parts = F.when(F.col("id") % 2 == 0, F.array(F.lit(2020), (F.col("id") % 12 + 1).cast("int"))).otherwise(F.array(F.lit(2020)))
    body = answer(F.struct(F.array(F.struct(F.col("url").alias("URL"), F.array(F.lit("A")).alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.col("source_name").alias("family"))).alias("author"), F.struct(F.array(parts).alias("date-parts")).alias("issued"))).alias("items")).alias("message"))
    return providers.registered_works(t.items.select("id", body.alias("j")), "j", ["id"]).drop("place")


@query("con_9", "SELECT id, CASE WHEN id % 2 = 0 THEN 'o/r/src/x.py' ELSE 'o/r' END AS title, CASE WHEN id % 2 = 0 THEN 'code' ELSE 'repository' END AS kind FROM items")
def _(t):
    hit = F.struct(F.col("url").alias("html_url"), F.lit("src/x.py").alias("path"), F.struct(F.lit("o/r").alias("full_name")).alias("repository"))
    one = answer(F.when(F.col("id") % 2 == 0, F.array(hit)).otherwise(F.filter(F.array(hit), lambda x: F.lit(False))).alias("items"))
    two = answer(F.array(F.struct(F.col("url").alias("html_url"), F.lit("o/r").alias("full_name"))).alias("items"))
    return providers.code(t.items.select("id", one.alias("a"), two.alias("b")), "a", "b", ["id"]).select("id", "title", "kind")


@query("con_10", "SELECT id, concat('Pic ', id) AS title, concat(url, '.jpg') AS image FROM items WHERE id % 3 > 0")
def _(t):
    info = F.when(F.col("id") % 3 > 0, F.array(F.struct(F.concat("url", F.lit(".jpg")).alias("url"))))
    body = answer(F.struct(F.create_map(F.col("id").cast("string"), F.struct(F.col("id").alias("pageid"), F.concat(F.lit("File:Pic "), F.col("id"), F.lit(".jpg")).alias("title"), info.alias("imageinfo"))).alias("pages")).alias("query"))
    return providers.commons(t.items.select("id", body.alias("j")), "j", ["id"]).select("id", "title", "image")


@query("con_11", "SELECT id, url, CASE WHEN id % 2 = 0 THEN 'me · BY-SA 4.0' ELSE 'BY-SA 4.0' END AS snippet FROM items")
def _(t):
    body = answer(F.array(F.struct(F.col("url"), F.lit("t").alias("title"), F.when(F.col("id") % 2 == 0, "me").otherwise("").alias("creator"), F.lit("by-sa").alias("license"), F.lit("4.0").alias("license_version"))).alias("results"))
    return providers.openly_licensed(t.items.select("id", body.alias("j")), "j", ["id"]).select("id", "url", "snippet")


@query("con_12", "SELECT id, concat('https://archive.org/details/a', id) AS url, CASE WHEN id % 2 = 0 THEN 'one' ELSE 'two' END AS title, '2020-01-02' AS published FROM items")
def _(t):
    one = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("a"), F.col("id")).alias("identifier"), F.lit("one").alias("title"), F.lit("2020-01-02T00:00:00Z").alias("date"))).alias("docs")).alias("response")))
    two = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("a"), F.col("id")).alias("identifier"), F.array(F.lit("two"), F.lit("three")).alias("title"), F.lit("2020-01-02").alias("date"))).alias("docs")).alias("response")))
    rows = t.items.select("id", F.when(F.col("id") % 2 == 0, one).otherwise(two).alias("j"))
    return providers.archive(rows, "j", ["id"]).select("id", "url", "title", "published")


@query("con_13", "SELECT id, concat('https://www.youtube.com/watch?v=v', id) AS url, '2020-01-02' AS published FROM items WHERE id % 2 = 0")
def _(t):
    body = answer(F.array(F.struct(F.struct(F.when(F.col("id") % 2 == 0, F.concat(F.lit("v"), F.col("id"))).alias("videoId")).alias("id"), F.struct(F.lit("t").alias("title"), F.lit("2020-01-02T03:04:05Z").alias("publishedAt")).alias("snippet"))).alias("items"))
    return providers.videos(t.items.select("id", body.alias("j")), "j", ["id"]).select("id", "url", "published")


@query("con_14", "SELECT id, concat('https://www.openstreetmap.org/node/', id) AS url, 'Name' AS title, CASE WHEN id % 2 = 0 THEN 'T, L' ELSE 'V, L' END AS snippet, 1.5::DOUBLE AS lat FROM items")
def _(t):
    address = F.struct(F.when(F.col("id") % 2 == 0, "T").alias("town"), F.lit("V").alias("village"), F.lit("L").alias("country"))
    body = F.to_json(F.array(F.struct(F.lit("node").alias("osm_type"), F.col("id").alias("osm_id"), F.lit("Name, of it").alias("display_name"), F.lit("1.5").alias("lat"), F.lit("x").alias("lon"), address.alias("address"))))
    return providers.places(t.items.select("id", body.alias("j")), "j", ["id"]).select("id", "url", "title", "snippet", "lat")


@query("con_15", "SELECT id, count(*) AS n FROM items CROSS JOIN (SELECT unnest(range(12)) AS k) WHERE k < CASE WHEN id % 8 < 5 THEN id % 8 + 4 ELSE id % 8 END GROUP BY id")
def _(t):
    list_ = lambda n: F.to_json(F.struct(F.transform(F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), n), lambda k: F.struct(F.concat(F.lit("p"), k).alias("title"), F.lit(1.0).alias("price"))).alias("products")))
    rows = t.items.select("id", list_((F.col("id") % 8).cast("int")).alias("a"), list_(F.lit(4)).alias("b"))
    return providers.products(rows, "a", "b", ["id"]).groupBy("id").agg(F.count("*").alias("n"))


@query("con_16", f"SELECT id, url, {TITLE_SQL} AS title, 'pass age' AS snippet FROM items")
def _(t):
    xml = F.concat(F.lit('<results><doc id="1"><url>'), F.col("url"), F.lit("</url><title><b>"), TITLE(), F.lit("</b></title><passage>pass <i>age</i></passage></doc><doc><title>no url</title></doc></results>"))
    return providers.xml_results(t.items.select("id", xml.alias("x")), "x", ["id"]).drop("place")


@query("con_18", "SELECT id, CASE WHEN k < 2 THEN 'Noun' ELSE 'Verb' END AS part, concat('d', CASE WHEN k < 2 THEN k ELSE k - 2 END) AS definition FROM items CROSS JOIN (SELECT unnest(range(4)) AS k)")
def _(t):
    defs = F.array(*[F.struct(F.lit(x).alias("definition")) for x in ("<b>d0</b>", "", "d1", "d2")])
    body = F.to_json(F.create_map(F.lit("en"), F.array(*[F.struct(F.lit(p).alias("partOfSpeech"), defs.alias("definitions")) for p in ("Noun", "Verb")])))
    return providers.definitions(t.items.select("id", body.alias("j")), "j", ["id"]).drop("place")


@query("con_17", """WITH s AS (SELECT * FROM (VALUES (0, 'P31', 'Q1', 'normal'), (1, 'P31', 'Q2', 'normal'), (2, 'P31', 'Q3', 'normal'), (3, 'P31', 'Q4', 'normal'), (4, 'P5', 'a', 'normal'), (5, 'P5', 'b', 'preferred'), (6, 'P6', 'c', 'deprecated'), (7, 'P7', 'd', 'normal'), (8, 'P7', 'd', 'normal')) x(place, property, value, rank))
SELECT id, property, CASE WHEN value LIKE 'Q%' THEN concat('label ', value) ELSE value END AS value FROM items CROSS JOIN s WHERE place IN (0, 1, 2, 5, 7) AND id % 2 = 0 UNION ALL SELECT id, property, CASE WHEN value LIKE 'Q%' THEN concat('label ', value) ELSE value END FROM items CROSS JOIN s WHERE place IN (0, 1, 2, 4, 7) AND id % 2 = 1""")
def _(t):
    rows = [(0, "P31", "Q1", "normal"), (1, "P31", "Q2", "normal"), (2, "P31", "Q3", "normal"), (3, "P31", "Q4", "normal"), (4, "P5", "a", "normal"), (5, "P5", "b", "preferred"), (6, "P6", "c", "deprecated"), (7, "P7", "d", "normal"), (8, "P7", "d", "normal")]
    statements = t.items.select(F.col("id").alias("entity")).crossJoin(F.broadcast(t.spark.createDataFrame(rows, "place int, property string, value string, rank string")))
    statements = statements.where(~((F.col("entity") % 2 == 1) & (F.col("place") == 5)))
    labels = t.spark.createDataFrame([(f"Q{k}", f"label Q{k}") for k in range(1, 5)], "id string, label string")
    return providers.claims(statements, labels).select(F.col("entity").alias("id"), "property", "value")


@query("rem_20", "SELECT id, CASE id % 5 WHEN 0 THEN '2020' WHEN 1 THEN '2020-03' WHEN 2 THEN '2020-03-04' WHEN 3 THEN '12 km' ELSE '+x' END AS text FROM items")
def _(t):
    k = F.col("id") % 5
    value = F.when(k == 0, "+2020-00-00T00:00:00Z").when(k == 1, "+2020-03-00T00:00:00Z").when(k == 2, "+2020-03-04T00:00:00Z").when(k == 3, "+12").otherwise("+x")
    kind = F.when(k < 3, "time").when(k == 3, "quantity").otherwise("string")
    return t.items.select("id", providers.claim_text(kind, value, F.lit("km")).alias("text"))
