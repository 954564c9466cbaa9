"""Feeds, sitemaps, wiki streams, repositories and trends, from captured texts: native parsing of blocks by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.batches import column
from lodestar.sources import records

ITEM = r"(?is)<item[\s>].*?</item>|<entry[\s>].*?</entry>"


def plain(text: Column) -> Column:
    """Tags to spaces, white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def tag(block: Column, name: str) -> Column:
    """Text of the first element of this name, CDATA unwrapped; empty without one."""
    inner = F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def _first(*choices: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def truncate(text: Column, most: int) -> Column:
    """At most so many characters, the last broken word left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", ""), F.lit("…")))


def feed_items(feeds: DataFrame, xml: str, keep: list[str], most: int = 40) -> DataFrame:
    """title, url, snippet, published and place of the first `most` items of each feed; items without title or link are left out."""
    b = F.col("_block")
    rows = feeds.select(*keep, F.posexplode(F.slice(F.regexp_extract_all(F.col(xml), F.lit(ITEM), F.lit(0)), 1, most)).alias("place", "_block"))
    link = _first(tag(b, "link"), F.regexp_extract(b, r'(?i)<link[^>]*href="([^"]+)"', 1))
    body = _first(tag(b, "description"), tag(b, "summary"), tag(b, "content"))
    out = rows.select(*keep, "place", plain(tag(b, "title")).alias("title"), link.alias("url"), body.alias("body"), _first(tag(b, "pubDate"), tag(b, "updated"), tag(b, "published"), tag(b, "dc:date")).alias("published"))
    return out.where("title <> '' and url <> ''").withColumn("snippet", truncate(plain(F.col("body")), 220))


def crawl_records(items: DataFrame, source: str, category: str, quality: float = 0.9, least: int = 20, most: int = 45_000) -> DataFrame:
    """Feed items as crawl records: those with url, title and a text of `least` characters or more."""
    text = F.substring(plain(F.col("body")), 1, most)
    rows = items.withColumn("content", text).where((F.length(plain(F.col("body"))) >= least) & (F.col("url") != "") & (F.col("title") != ""))
    return rows.select(
        "url", "title", "content", F.substring("content", 1, 200).alias("description"), "published", F.lit("en").alias("language"), F.size(F.split("content", r"\s+")).alias("word_count"),
        F.sha2("content", 256).alias("content_hash"), F.lit(source).alias("source_name"), F.lit(category).alias("category"), F.lit(quality).alias("source_quality"),
    )


def search_feed(items: DataFrame, tokens: list[str]) -> DataFrame:
    """Items by the share of tokens that title and snippet hold, then the date; all of them if none holds any."""
    hay = F.lower(F.concat_ws(" ", "title", "snippet"))
    hits = sum((F.contains(hay, F.lit(t.lower())).cast("int") for t in tokens), F.lit(0))
    scored = items.withColumn("match", hits / max(1, len(tokens)))
    some = scored.agg((F.max("match") > 0).alias("_some"))
    return scored.crossJoin(F.broadcast(some)).where((F.col("match") > 0) | ~F.col("_some")).drop("_some")


def sitemap_entries(xml: Column) -> Column:
    """Array of (url, lastmod, priority, changefreq) of a url set."""
    pick = lambda e, n: F.trim(F.regexp_extract(e, rf"(?is)<{n}>(.*?)</{n}>", 1))
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    one = lambda e: F.struct(pick(e, "loc").alias("url"), pick(e, "lastmod").alias("lastmod"), F.coalesce(F.nullif(pick(e, "priority"), F.lit("")).try_cast("double"), F.lit(0.5)).alias("priority"), _first(pick(e, "changefreq"), F.lit("weekly")).alias("changefreq"))
    return F.filter(F.transform(blocks, one), lambda e: e["url"] != "")


def sitemap_tree(files: DataFrame, roots: DataFrame, depth: int = 2, each: int = 10, most: int = 2000) -> DataFrame:
    """Entries below each root (host, url) by the files (url, xml): indexes are followed `depth` levels down, `each` of an index, `most` entries a host.

    Each url counts once, where it is met first.
    """
    level = roots.select("host", F.col("url").alias("at"), F.array(F.lit(0)).alias("path"))
    found = None
    for k in range(depth + 1):
        here = level.join(files, level["at"] == files["url"]).select("host", "path", "xml")
        is_index = F.lower("xml").contains("<sitemapindex")
        own = here.where(~is_index).select("host", "path", F.posexplode(sitemap_entries(F.col("xml"))).alias("pos", "e")).select("host", "path", "pos", "e.*")
        found = own if found is None else found.unionByName(own)
        locs = F.slice(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), 1, each)
        if k < depth:
            level = here.where(is_index).select("host", F.posexplode(locs).alias("pos", "at"), "path").select("host", "at", F.concat("path", F.array("pos")).alias("path"))
    first = found.groupBy("host", "url").agg(F.min(F.struct("path", "pos", "lastmod", "priority", "changefreq")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("m.path", "m.pos"))
    return first.withColumn("_r", rank).where(F.col("_r") <= most).select("host", "url", "m.lastmod", "m.priority", "m.changefreq")


def _unescape(x: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def wiki_pages(streams: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """page_id, title, wikitext and revision time of articles in streams: namespace 0, no redirects, with text. A page cut off at the end is left out."""
    b = F.col("_page")
    rows = streams.select(*keep, F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<page>.*?</page>"), F.lit(0))).alias("_page"))
    revision = F.regexp_extract(b, r"(?s)<revision>(.*?)</revision>", 1)
    text = F.when(F.regexp_extract(revision, r"(<text[^>]*>)", 1).rlike(r"deleted="), "").otherwise(_unescape(F.regexp_extract(revision, r"(?s)<text[^>]*>(.*?)</text>", 1)))
    out = rows.where((tag(b, "ns") == "0") & ~b.rlike("<redirect[ />]") & (revision != ""))
    # the page's own id comes before its revision
    return out.select(*keep, tag(F.regexp_replace(b, r"(?s)<revision>.*</revision>", ""), "id").alias("page_id"), _unescape(tag(b, "title")).alias("title"), text.alias("wikitext"), tag(revision, "timestamp").alias("revised")).where(F.trim("wikitext") != "")


def wiki_records(pages: DataFrame, language: str = "en", least: int = 200, most: int = 45_000) -> DataFrame:
    """Articles as crawl records: plain text of `least` characters or more, cut at `most`, with their links."""

    def read(markup):
        return [{"text": records.wikitext(x or ""), "links": records.wiki_links(x or "")} for x in markup]

    rows = pages.withColumn("_r", column(read, "struct<text: string, links: array<string>>")("wikitext")).where(F.length("_r.text") >= least)
    url = F.concat(F.lit(f"https://{language}.wikipedia.org/wiki/"), F.replace(F.url_encode(F.replace("title", F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))
    text = F.substring(F.col("_r.text"), 1, most)
    return rows.select("page_id", url.alias("url"), "title", text.alias("content"), F.col("_r.links").alias("links"), F.lit(language).alias("language"), F.sha2(text, 256).alias("content_hash"), F.substring("revised", 1, 10).alias("published"), F.lit(0.98).alias("source_quality"))


REPO = "full_name string, name string, html_url string, description string, topics array<string>, language string, license struct<spdx_id: string>, stargazers_count long, fork boolean, owner struct<login: string>, created_at string"


def repositories(rows: DataFrame, json: str, source_quality: float = 0.9) -> DataFrame:
    """Repository objects as crawl records; authority grows with stars to 0.95, quality stays in 0.7 to 0.95."""
    r = rows.select(F.from_json(json, REPO).alias("r")).select("r.*")
    name = _first(F.col("full_name"), F.col("name"))
    about, stars = F.trim(F.coalesce("description", F.lit(""))), F.coalesce("stargazers_count", F.lit(0))
    text = F.concat(
        name, F.lit(": "), about, F.lit(" Language "), F.coalesce("language", F.lit("unknown")), F.lit(" · License "), F.coalesce("license.spdx_id", F.lit("unknown")),
        F.lit(" · Topics "), F.array_join(F.coalesce("topics", F.array().cast("array<string>")), ", "), F.lit(" · stars "), stars.cast("string"),
    )
    authority = 0.5 + F.least(F.lit(0.45), F.least(stars, F.lit(50_000)) / 50_000 * 0.45)
    quality = F.greatest(F.lit(0.7), F.least(F.lit(0.95), source_quality - 0.05 + stars / 100_000))
    out = r.where((F.coalesce("html_url", F.lit("")) != "") & (name != ""))
    return out.select(F.col("html_url").alias("url"), name.alias("title"), text.alias("content"), F.coalesce("owner.login", F.lit("")).alias("author"), F.substring("created_at", 1, 10).alias("published"), authority.alias("authority"), quality.alias("quality"), stars.alias("stars"))


TRENDS = "map<string, array<struct<title: string, traffic: string, news: array<struct<title: string, url: string>>>>>"


def trends(rows: DataFrame, json: str, each: int = 10, news: int = 3, words: list[str] | None = None) -> DataFrame:
    """country, place, title and up to `news` stories of up to `each` trends a country; with words, only titles that hold one."""
    t = rows.select(F.explode(F.from_json(json, TRENDS)).alias("country", "list")).select("country", F.posexplode(F.slice("list", 1, each)).alias("place", "t"))
    if words:
        t = t.where(F.lower("t.title").rlike("|".join(words)))
    return t.select("country", "place", "t.title", F.slice(F.coalesce("t.news", F.array().cast("array<struct<title: string, url: string>>")), 1, news).alias("news"))


def clean_extract(text: Column, most: int = 5000) -> Column:
    """An encyclopedia extract without reference marks and headings, cut at the last space if that lies in the last 500 characters."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\d+\]|\[edit\]", ""), r"\n\n=+.*?=+\n\n", "\n\n")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), " {2,}", " "))
    head = F.substring(t, 1, most)
    cut = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(t) <= most, t).when(F.length(cut) > most - 500, cut).otherwise(head)
