"""Answers of search providers, from captured JSON or XML texts to result rows: provider, url, title, snippet, published and what else each has.

Each mapper takes a DataFrame and the name of the column with the answer, and works by expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.select import host, on_list
from lodestar.sources.feeds import plain, tag, truncate


def _rows(answers: DataFrame, body: str, schema: str, path: str, keep: list[str]) -> DataFrame:
    """One row an element of the array at `path` of the answer; a broken answer has none."""
    doc = F.from_json(body, schema)
    return answers.select(*keep, F.posexplode(doc[path]).alias("place", "r"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def news(answers: DataFrame, body: str, keep: list[str], domains: list[str]) -> DataFrame:
    """News articles of allowed hosts; compact times as days."""
    r = _rows(answers, body, "articles array<struct<url: string, title: string, seendate: string, domain: string, socialimage: string>>", "articles", keep)
    day = F.regexp_replace(F.substring("r.seendate", 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return r.where(on_list(host(F.col("r.url")), domains)).select(*keep, "place", "r.url", plain(F.col("r.title")).alias("title"), day.alias("published"))


WORK = "results array<struct<id: string, doi: string, display_name: string, publication_date: string, cited_by_count: long, abstract_inverted_index: map<string, array<int>>>>"


def abstract(index: Column) -> Column:
    """The text of a map from words to their places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def works(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Scholarly works with their abstracts put together again."""
    r = _rows(answers, body, WORK, "results", keep)
    return r.select(*keep, "place", F.coalesce("r.doi", "r.id").alias("url"), "r.display_name", abstract(F.col("r.abstract_inverted_index")).alias("snippet"), _text(F.col("r.publication_date")).alias("published"), F.coalesce("r.cited_by_count", F.lit(0)).alias("cited"))


def registered_works(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Registered works: date parts padded and joined, the first author, the first title."""
    schema = "message struct<items: array<struct<URL: string, title: array<string>, author: array<struct<given: string, family: string>>, issued: struct<`date-parts`: array<array<int>>>>>>"
    doc = F.from_json(body, schema)["message"]["items"]
    r = answers.select(*keep, F.posexplode(doc).alias("place", "r"))
    parts = F.coalesce(F.get(F.col("r.issued.`date-parts`"), 0), F.array().cast("array<int>"))
    day = F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0"))), "-")
    a = F.get(F.col("r.author"), 0)
    return r.select(*keep, "place", F.col("r.URL").alias("url"), _text(F.get(F.col("r.title"), 0)).alias("title"), F.trim(F.concat_ws(" ", a["given"], a["family"])).alias("author"), day.alias("published"))


def code(answers: DataFrame, code_body: str, repo_body: str, keep: list[str]) -> DataFrame:
    """Code hits, and repositories where an answer has no code hit."""
    c = F.from_json(code_body, "items array<struct<html_url: string, path: string, repository: struct<full_name: string>>>")["items"]
    r = F.from_json(repo_body, "items array<struct<html_url: string, full_name: string, description: string>>")["items"]
    hits = F.transform(c, lambda x: F.struct(x["html_url"].alias("url"), F.concat_ws("/", x["repository"]["full_name"], x["path"]).alias("title"), F.lit("code").alias("kind")))
    repos = F.transform(r, lambda x: F.struct(x["html_url"].alias("url"), x["full_name"].alias("title"), F.lit("repository").alias("kind")))
    return answers.select(*keep, F.posexplode(F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, hits).otherwise(repos)).alias("place", "r")).select(*keep, "place", "r.*")


def commons(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Files from a map of pages; those without a url are left out."""
    schema = "query struct<pages: map<string, struct<pageid: long, title: string, imageinfo: array<struct<url: string, thumburl: string, descriptionurl: string>>>>>"
    pages = answers.select(*keep, F.explode(F.from_json(body, schema)["query"]["pages"]).alias("k", "p"))
    info = F.get(F.col("p.imageinfo"), 0)
    return pages.where(_text(info["url"]) != "").select(*keep, F.coalesce(info["descriptionurl"], info["url"]).alias("url"), F.regexp_replace("p.title", r"^File:|\.[A-Za-z0-9]+$", "").alias("title"), info["url"].alias("image"), info["thumburl"].alias("thumbnail"))


def openly_licensed(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Pictures with creator and licence as the snippet."""
    r = _rows(answers, body, "results array<struct<url: string, foreign_landing_url: string, title: string, creator: string, license: string, license_version: string>>", "results", keep)
    licence = F.concat_ws(" ", F.upper(F.col("r.license")), F.col("r.license_version"))
    return r.select(*keep, "place", F.coalesce("r.foreign_landing_url", "r.url").alias("url"), _text(F.col("r.title")).alias("title"), F.concat_ws(" · ", F.nullif("r.creator", F.lit("")), F.nullif(licence, F.lit(""))).alias("snippet"))


def first_value(raw: Column) -> Column:
    """A field that is a text or a list of texts, as one text."""
    return F.coalesce(F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), 0)).otherwise(raw), F.lit(""))


def archive(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Archive items whose fields are scalars or lists."""
    docs = F.get_json_object(body, "$.response.docs")
    r = answers.select(*keep, F.posexplode(F.from_json(docs, "array<map<string, string>>")).alias("place", "r"))
    field = lambda n: first_value(F.col("r")[n])
    return r.where(field("identifier") != "").select(*keep, "place", F.concat(F.lit("https://archive.org/details/"), field("identifier")).alias("url"), field("title").alias("title"), truncate(plain(field("description")), 220).alias("snippet"), F.substring(field("date"), 1, 10).alias("published"))


def videos(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Videos; entries without a video id (channels, lists) are left out."""
    r = _rows(answers, body, "items array<struct<id: struct<videoId: string>, snippet: struct<title: string, description: string, publishedAt: string, channelTitle: string>>>", "items", keep)
    return r.where(_text(F.col("r.id.videoId")) != "").select(*keep, "place", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("r.id.videoId")).alias("url"), plain(F.col("r.snippet.title")).alias("title"), _text(F.col("r.snippet.description")).alias("snippet"), F.substring("r.snippet.publishedAt", 1, 10).alias("published"), F.col("r.snippet.channelTitle").alias("author"))


def places(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Places with the smallest settlement that the address names, and coordinates."""
    schema = "array<struct<osm_type: string, osm_id: long, display_name: string, lat: string, lon: string, address: struct<city: string, town: string, village: string, county: string, country: string>>>"
    r = answers.select(*keep, F.posexplode(F.from_json(body, schema)).alias("place", "r"))
    a = F.col("r.address")
    where = F.concat_ws(", ", F.coalesce(a["city"], a["town"], a["village"], a["county"]), a["country"])
    url = F.concat(F.lit("https://www.openstreetmap.org/"), F.col("r.osm_type"), F.lit("/"), F.col("r.osm_id"))
    return r.select(*keep, "place", url.alias("url"), F.regexp_extract("r.display_name", "^([^,]*)", 1).alias("title"), where.alias("snippet"), F.col("r.lat").try_cast("double").alias("lat"), F.col("r.lon").try_cast("double").alias("lon"))


def products(answers: DataFrame, first: str, second: str, keep: list[str], enough: int = 5) -> DataFrame:
    """Products of the first answer, and of the second where the first has fewer than `enough`."""
    schema = "products array<struct<title: string, url: string, price: double, rating: double>>"
    a, b = (F.coalesce(F.from_json(c, schema)["products"], F.array().cast("array<struct<title: string, url: string, price: double, rating: double>>")) for c in (first, second))
    rows = answers.select(*keep, F.posexplode(F.when(F.size(a) < enough, F.concat(a, b)).otherwise(a)).alias("place", "r"))
    return rows.select(*keep, "place", "r.*")


def xml_results(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Web results of an XML answer; documents without a url are left out."""
    docs = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<doc[\s>].*?</doc>"), F.lit(0))
    r = answers.select(*keep, F.posexplode(docs).alias("place", "b"))
    out = r.select(*keep, "place", tag(F.col("b"), "url").alias("url"), plain(tag(F.col("b"), "title")).alias("title"), plain(F.coalesce(F.nullif(tag(F.col("b"), "passage"), F.lit("")), tag(F.col("b"), "headline"))).alias("snippet"))
    return out.where("url <> ''")


def definitions(answers: DataFrame, body: str, keep: list[str], language: str = "en", block: int = 2, most: int = 8) -> DataFrame:
    """Definitions of a word: `block` of each part of speech, `most` in all, without tags and empty ones."""
    schema = "map<string, array<struct<partOfSpeech: string, definitions: array<struct<definition: string>>>>>"
    blocks = F.coalesce(F.from_json(body, schema)[language], F.array().cast("array<struct<partOfSpeech: string, definitions: array<struct<definition: string>>>>"))
    texts = lambda b: F.filter(F.transform(b["definitions"], lambda d: plain(d["definition"])), lambda x: x != "")
    each = F.transform(blocks, lambda b: F.transform(F.slice(texts(b), 1, block), lambda x: F.struct(b["partOfSpeech"].alias("part"), x.alias("definition"))))
    return answers.select(*keep, F.posexplode(F.slice(F.flatten(each), 1, most)).alias("place", "r")).select(*keep, "place", "r.*")


def best_entity(hits: DataFrame, query: str, label: str, place: str, by: list[str]) -> DataFrame:
    """The entity that answers a query: equal label, else one that begins with it, else one that holds it, else the first."""
    q, name = F.lower(F.trim(query)), F.lower(F.trim(label))
    rung = F.when(name == q, 0).when(F.startswith(name, q), 1).when(F.contains(name, q), 2).otherwise(3)
    return hits.groupBy(*by).agg(F.min(F.struct(rung.alias("rung"), F.col(place), F.struct(*hits.columns).alias("row"))).alias("m")).select("m.row.*", "m.rung")


def claims(statements: DataFrame, labels: DataFrame, entity: str = "entity", each: int = 2, more: dict[str, int] | None = None, most: int = 14) -> DataFrame:
    """Attributes of an entity's card from statements (entity, place, property, value, rank): preferred ones where a property has any, never
    deprecated ones, `each` of a property (`more` for some), equal labels once, `most` in all. labels: id, label."""
    from pyspark.sql import Window

    top = F.max(F.col("rank") == "preferred").over(Window.partitionBy(entity, "property"))
    kept = statements.where("rank <> 'deprecated'").withColumn("_top", top).where("not _top or rank = 'preferred'")
    named = kept.join(labels.select(F.col("id").alias("_i"), F.col("label").alias("_l")), F.col("value") == F.col("_i"), "left").withColumn("value", F.coalesce("_l", "value")).drop("_i", "_l", "_top")
    first = named.groupBy(entity, "property", "value").agg(F.min("place").alias("place"))
    allowed = F.coalesce(*[F.when(F.col("property") == k, v) for k, v in (more or {"P31": 3}).items()], F.lit(each))
    rank = F.row_number().over(Window.partitionBy(entity, "property").orderBy("place", "value"))
    capped = first.withColumn("_r", rank).where(F.col("_r") <= allowed).drop("_r")
    whole = F.row_number().over(Window.partitionBy(entity).orderBy("place", "property", "value"))
    return capped.withColumn("_r", whole).where(F.col("_r") <= most).drop("_r")


def claim_text(kind: Column, value: Column, unit: Column | None = None) -> Column:
    """A statement's value for reading: a time by its precision, a quantity with its unit, anything else as it is."""
    day = F.regexp_extract(value, r"^\+?(\d{4}-\d{2}-\d{2})", 1)
    time = F.when(day.endswith("-00-00"), F.substring(day, 1, 4)).when(day.endswith("-00"), F.substring(day, 1, 7)).otherwise(day)
    amount = F.concat_ws(" ", F.regexp_replace(value, r"^\+", ""), F.nullif(unit, F.lit("1")) if unit is not None else F.lit(None).cast("string"))
    return F.when(kind == "time", time).when(kind == "quantity", amount).otherwise(value)
