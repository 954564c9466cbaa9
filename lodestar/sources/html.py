"""Page extraction with the standard library's parser, as a UDF over whole documents."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.batches import column

FIELDS = {
    "title": "string", "description": "string", "canonical": "string", "robots": "string", "language": "string", "h1": "array<string>", "h2": "array<string>", "text": "string", "word_count": "bigint",
    "content_hash": "string", "links": "array<struct<url: string, anchor: string, nofollow: boolean>>", "media": "array<struct<url: string, type: string, alt: string>>",
}
SKIP = {"script", "style", "nav", "footer", "aside", "noscript", "form", "template"}


class Page(HTMLParser):
    """Collects what FIELDS names; unclosed tags do no harm."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.skip, self.text, self.links, self.media = url, [], [], [], []
        self.head = {"title": "", "description": "", "canonical": "", "robots": "", "language": ""}
        self.h = {"h1": [], "h2": []}
        self.into, self.anchor = None, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in SKIP:
            self.skip.append(tag)
        elif tag == "html":
            self.head["language"] = a.get("lang", "")[:2].lower()
        elif tag == "meta" and a.get("name", "").lower() in ("description", "robots"):
            self.head[a["name"].lower()] = a.get("content", "")
        elif tag == "link" and "canonical" in a.get("rel", ""):
            self.head["canonical"] = urljoin(self.url, a.get("href", ""))
        elif tag in ("title", "h1", "h2"):
            self.into = (tag, [])
        elif tag == "a" and a.get("href"):
            self.anchor = [urljoin(self.url, a["href"]), [], "nofollow" in a.get("rel", "")]
        elif tag in ("img", "video", "audio", "iframe") and (a.get("src") or a.get("srcset")):
            src = a.get("src") or a["srcset"].split(",")[-1].split()[0]
            self.media.append({"url": urljoin(self.url, src), "type": "image" if tag == "img" else tag, "alt": a.get("alt", "")})
        if tag in ("p", "br", "div", "li", "h1", "h2", "h3", "tr"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip and self.skip.pop() != tag:
                pass
        elif tag == "a" and self.anchor:
            url, words, nofollow = self.anchor
            if url.startswith(("http://", "https://")):
                self.links.append({"url": url, "anchor": " ".join("".join(words).split()), "nofollow": nofollow})
            self.anchor = None
        elif self.into and tag == self.into[0]:
            value = " ".join("".join(self.into[1]).split())
            if tag == "title":
                self.head["title"] = self.head["title"] or value
            elif value:
                self.h[tag].append(value)
            self.into = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.into:
            self.into[1].append(data)
        if self.anchor:
            self.anchor[1].append(data)
        if not (self.into and self.into[0] == "title"):
            self.text.append(data)


def extract(html: str, url: str) -> dict:
    page = Page(url or "")
    page.feed(html or "")
    page.close()
    text = re.sub(r"[ \t]+", " ", "".join(page.text))
    text = re.sub(r"\s*\n\s*", "\n", text).strip()
    return {**page.head, **page.h, "text": text, "word_count": len(text.split()), "content_hash": hashlib.md5(text.encode()).hexdigest(), "links": page.links, "media": page.media[:30]}


def pages(table: DataFrame, html_col: str = "html", url_col: str = "url", fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """`table` with the struct `page` of `fields`."""

    def parse(htmls, urls):
        return [{k: page[k] for k in fields} for page in map(extract, htmls, urls)]

    return table.withColumn("page", column(parse, "struct<" + ", ".join(f"{k}: {FIELDS[k]}" for k in fields) + ">")(html_col, url_col))


def backlinks(table: DataFrame) -> DataFrame:
    """source_url, target_url, anchor, nofollow, internal for every link of every page."""
    rows = pages(table, fields=("links",)).select(F.col("url").alias("source_url"), F.explode("page.links").alias("l"))
    return rows.select("source_url", F.col("l.url").alias("target_url"), F.col("l.anchor").alias("anchor"), F.col("l.nofollow").alias("nofollow"), (F.parse_url("l.url", F.lit("HOST")) == F.parse_url("source_url", F.lit("HOST"))).alias("internal"))


def host_of(url: str) -> str:
    return urlsplit(url).netloc.lower().removeprefix("www.")
