"""Structured data of pages: JSON-LD, Open Graph, Twitter, meta tags and microdata, ladders over them, media lists, lenient dates."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "schema_org array<string>, open_graph map<string, string>, twitter_card map<string, string>, meta_tags map<string, string>, microdata array<string>, dates array<string>"
#: A meta tag counts if its name holds one of these.
META = ["description", "author", "keywords", "robots", "date", "pubdate", "publish_date", "last-modified", "article:published_time", "article:modified_time", "article:author", "article:section", "article:tag"]
#: What a type's name holds, in order, and the kind that it means.
KINDS = [("article", "article"), ("blog", "blog_post"), ("recipe", "recipe"), ("faq", "faq"), ("questions", "faq"), ("howto", "how_to"), ("how-to", "how_to"), ("event", "event"), ("product", "product"), ("organization", "organization"), ("person", "person"), ("book", "book"), ("course", "course")]


class _Collector(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.script = None
        self.found = {"schema_org": [], "open_graph": {}, "twitter_card": {}, "meta_tags": {}, "microdata": [], "dates": []}
        self.nodes: list = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "script" and a.get("type", "").split(";")[0].strip().lower() == "application/ld+json":
            self.script = []
        elif tag == "meta":
            name, prop, content = a.get("name", ""), a.get("property", ""), a.get("content", "")
            for key, start, into in ((prop, "og:", "open_graph"), (name, "twitter:", "twitter_card")):
                if key.startswith(start):
                    self.found[into][key[len(start) :]] = content
            key = name.lower() or prop.lower()
            if any(k in key for k in META):
                self.found["meta_tags"][key] = content
        if "itemscope" in a and a.get("itemtype"):
            self.found["microdata"].append(a["itemtype"])

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            try:
                data = json.loads("".join(self.script))
            except ValueError:
                data = None
            self.found["schema_org"] += [json.dumps(x) for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]
            self.walk(data)
            self.script = None

    def walk(self, data):
        waiting = [data]
        while waiting:
            node = waiting.pop()
            if isinstance(node, dict):
                self.nodes.append(node)
                if isinstance(node.get("@graph"), list):
                    waiting += node["@graph"]
            elif isinstance(node, list):
                waiting += node


def read_page(html: str | None) -> dict:
    """All of FOUND of one page; broken scripts are skipped."""
    c = _Collector()
    c.feed(html or "")
    c.close()
    c.found["dates"] = [n[k] for k in ("datePublished", "dateCreated", "dateModified") for n in c.nodes if isinstance(n.get(k), str)]
    return c.found


def extract(html: Column) -> Column:
    """The struct FOUND of a column of pages."""

    @F.pandas_udf(FOUND)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(p) for p in pages], columns=[x.split()[0] for x in ("schema_org", "open_graph", "twitter_card", "meta_tags", "microdata", "dates")])

    return run(html)


def _first(*choices: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def author(found: Column) -> Column:
    """The first author of the JSON-LD objects, whatever its form, else of Open Graph, else of the meta tags."""

    def of(schema):
        text = F.get_json_object(schema, "$.author")
        name = F.coalesce(F.get_json_object(schema, "$.author.name"), F.get_json_object(schema, "$.author[0].name"), F.get_json_object(schema, "$.author[0]"))
        return F.when(text.rlike(r"^[\[{]"), F.coalesce(name, F.lit(""))).otherwise(text)

    named = F.filter(F.transform(found["schema_org"], of), lambda x: x.isNotNull())
    return _first(F.try_element_at(named, F.lit(1)), found["open_graph"]["article:author"], found["meta_tags"]["author"], found["meta_tags"]["article:author"])


def published(found: Column) -> Column:
    """The first date of the JSON-LD objects, else of Open Graph, else of the meta tags."""
    of = lambda s: F.coalesce(F.get_json_object(s, "$.datePublished"), F.get_json_object(s, "$.dateCreated"))
    dated = F.filter(F.transform(found["schema_org"], of), lambda x: x.isNotNull())
    return _first(F.try_element_at(dated, F.lit(1)), found["open_graph"]["article:published_time"], *[found["meta_tags"][k] for k in ("date", "pubdate", "publish_date", "article:published_time")])


def content_type(found: Column) -> Column:
    """The kind that the first JSON-LD type with a known name means."""

    def of(schema):
        t, out = F.lower(F.coalesce(F.get_json_object(schema, "$['@type']"), F.lit(""))), F.lit(None).cast("string")
        for part, kind in reversed(KINDS):
            out = F.when(t.contains(part), kind).otherwise(out)
        return out

    known = F.filter(F.transform(found["schema_org"], of), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("webpage"))


MEDIA = "array<struct<url: string, type: string, alt: string, caption: string, width: int, height: int, is_featured: boolean>>"


def media(text: Column) -> Column:
    """A media list from its JSON; what is no list is an empty one."""
    return F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, MEDIA)), F.array().cast(MEDIA))


def media_of(items: Column, kinds: list[str], most: int) -> Column:
    """Up to `most` entries of these kinds that have a url."""
    return F.slice(F.filter(items, lambda m: m["type"].isin(*kinds) & (F.coalesce(m["url"], F.lit("")) != "")), 1, most)


def largest_source(srcset: Column) -> Column:
    """The last candidate of a srcset."""
    return F.regexp_extract(F.element_at(F.split(F.trim(srcset), r"\s*,\s*"), -1), r"^(\S+)", 1)


def large_enough(width: Column, height: Column, least: int = 32) -> Column:
    """Pictures with a known side under `least` are left out."""
    return (F.coalesce(width, F.lit(least)) >= least) & (F.coalesce(height, F.lit(least)) >= least)


def normal_date(text: Column) -> Column:
    """YYYY-MM-DD of an ISO date, Y/M/D or a mail date; empty where it is none or a part is out of range."""
    t = F.trim(F.coalesce(text, F.lit("")))
    part = lambda p, i: F.lpad(F.regexp_extract(t, p, i), 2, "0")
    iso, slash, mail = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})/(\d{1,2})/(\d{1,2})", r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"
    month = F.lpad(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.regexp_extract(t, mail, 2))) + 2) / 3).cast("int").cast("string"), 2, "0")
    made = F.when(t.rlike(iso), F.concat_ws("-", F.regexp_extract(t, iso, 1), part(iso, 2), part(iso, 3))).when(t.rlike(slash), F.concat_ws("-", F.regexp_extract(t, slash, 1), part(slash, 2), part(slash, 3)))
    made = F.coalesce(made, F.when(t.rlike(mail), F.concat_ws("-", F.regexp_extract(t, mail, 3), month, part(mail, 1))), F.lit(""))
    return F.when(made.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"), made).otherwise("")


def resolve_date(candidates: Column) -> Column:
    """The first candidate of a list that is a date."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(candidates, normal_date), lambda d: d != ""), F.lit(1)), F.lit(""))


def lenient_time(text: Column) -> Column:
    """A time in one of six forms, else the middle of a year from 2000 on that the text names, else null."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy")]
    year = F.nullif(F.regexp_extract(text, r"(20\d{2})", 1), F.lit(""))
    return F.coalesce(*tries, F.try_to_timestamp(F.concat(year, F.lit("-06-01")), F.lit("yyyy-MM-dd")))
