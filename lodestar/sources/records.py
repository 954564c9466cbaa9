"""Line and record formats: JSON lines, crawl indexes, archive records, robots rules, sitemaps, logs, feeds."""

from __future__ import annotations

import gzip
import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.batches import column

CDX = "url string, timestamp string, mime string, status string, digest string, filename string, offset string, length string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of JSON-lines files that match `path`; blank and broken lines are skipped."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null").drop("_broken")


def cdx(lines: DataFrame) -> DataFrame:
    """Index lines (column `value`, JSON after an optional key) that name a url and a file."""
    row = F.from_json(F.regexp_extract("value", r"(\{.*\})", 1), CDX)
    out = lines.select(row.alias("r")).select("r.*").where("url <> '' and filename <> ''")
    return out.withColumns({"mime": F.lower("mime"), "offset": F.expr("try_cast(offset as bigint)"), "length": F.expr("try_cast(length as bigint)")})


def index_lines(lines: DataFrame) -> DataFrame:
    """offset:page_id:title lines; titles may hold colons."""
    p = F.split("value", ":", 3)
    return lines.where(F.size(p) == 3).select(F.expr("try_cast(split(value, ':', 3)[0] as bigint)").alias("offset"), F.expr("try_cast(split(value, ':', 3)[1] as bigint)").alias("page_id"), p[2].alias("title"))


def log_lines(lines: DataFrame) -> DataFrame:
    """'time - logger - level - module - message' lines."""
    p = F.split("value", " - ", 5)
    return lines.where(F.size(p) == 5).select(*[p[i].alias(n) for i, n in enumerate(("timestamp", "logger", "level", "module", "message"))])


def dechunk(body: bytes) -> bytes:
    """HTTP chunked transfer decoding; a body that isn't chunked comes back as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end > at else -1
        except ValueError:
            size = -1
        if size < 0:
            return b"".join(out) if out else body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def archive_response(record: bytes) -> tuple[str, str] | None:
    """(content type, html) of a gzipped response record; None for others, and where robots forbid indexing."""
    try:
        data = gzip.decompress(record) if record[:2] == b"\x1f\x8b" else record
    except (OSError, EOFError):
        return None
    parts = data.split(b"\r\n\r\n", 2)
    if len(parts) < 3 or b"warc-type: response" not in parts[0].lower():
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in parts[1].decode("latin-1").split("\r\n")[1:])}
    body = parts[2]
    if "noindex" in headers.get("x-robots-tag", "").lower() or "html" not in headers.get("content-type", "").lower():
        return None
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = dechunk(body)
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            return None
    return headers["content-type"], body.decode("utf-8", "replace")


def robots_rules(text: str, agent: str) -> list[tuple[str, str]]:
    """(allow | disallow | sitemap | delay, value) of the agent's own group, or of the group for all."""
    groups: dict[str, list[tuple[str, str]]] = {}
    always, names, open_group = [], [], False
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if open_group else [value.lower()]
            open_group = True
            groups.setdefault(value.lower(), [])
        elif key == "sitemap" and value:
            always.append(("sitemap", value))
        elif key in ("allow", "disallow", "crawl-delay"):
            open_group = False
            for name in names:
                if value:
                    groups[name].append(("delay" if key == "crawl-delay" else key, value))
    own = next((g for n, g in groups.items() if n != "*" and n in agent.lower()), groups.get("*", []))
    return own + always


def allowed(rules: list[tuple[str, str]], path: str) -> bool:
    """Longest matching pattern decides, with * and $; allow wins ties."""
    best = (-1, True)
    for kind, pattern in rules:
        if kind in ("allow", "disallow"):
            body = re.escape(pattern.rstrip("$")).replace(r"\*", ".*")
            if re.match(body + ("$" if pattern.endswith("$") else ""), path):
                best = max(best, (len(pattern), kind == "allow"))
    return best[1]


ROBOTS_ROW = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def robots_table(sites: DataFrame, agent: str) -> DataFrame:
    """host, kind, value of robots files (host, text)."""

    @F.pandas_udf(ROBOTS_ROW)
    def rules(texts):
        return texts.map(lambda t: [{"kind": k, "value": v} for k, v in robots_rules(t or "", agent)])

    return sites.select("host", F.explode(rules("text")).alias("r")).select("host", "r.kind", "r.value")


def sitemap(xml: DataFrame) -> DataFrame:
    """url, lastmod, priority (0.5) and changefreq (weekly) of sitemap texts (column `value`)."""
    entries = xml.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("e"))
    tag = lambda n: F.trim(F.regexp_extract("e", rf"(?s)<{n}>(.*?)</{n}>", 1))
    return entries.select(
        tag("loc").alias("url"), tag("lastmod").alias("lastmod"),
        F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(e, '<priority>(.*?)</priority>', 1), '') as double)"), F.lit(0.5)).alias("priority"),
        F.coalesce(F.nullif(tag("changefreq"), F.lit("")), F.lit("weekly")).alias("changefreq"),
    ).where("url <> ''")


#: Elements that go with all they hold.
DROPPED = {"ref", "gallery", "timeline", "math", "score", "syntaxhighlight"}
NAMESPACES = {"file", "image", "category"}
ELEMENT = re.compile(r"<(/?)([a-zA-Z]+)[^>]*?(/?)>")


def _closing(text: str, at: int, open_: str, close: str) -> int:
    """Where the bracket that opens at `at` is closed again (behind it), -1 if it isn't."""
    depth, i = 0, at
    while i < len(text):
        if text.startswith(open_, i):
            depth, i = depth + 1, i + len(open_)
        elif text.startswith(close, i):
            depth, i = depth - 1, i + len(close)
            if not depth:
                return i
        else:
            i += 1
    return -1


def _unmarked(text: str) -> str:
    """One walk over the markup, from bracket to bracket."""
    out, i = [], 0
    while i < len(text):
        jump = re.compile(r"<|\{\{|\{\||\[|''|__[A-Z]+__").search(text, i)
        if not jump:
            out.append(text[i:])
            break
        out.append(text[i : jump.start()])
        i, sign = jump.start(), jump.group()
        end = -1
        if sign == "<":
            if text.startswith("<!--", i):
                end = text.find("-->", i)
                end = len(text) if end < 0 else end + 3
            elif element := ELEMENT.match(text, i):
                end = element.end()
                if element[2].lower() in DROPPED and not element[1] and not element[3]:
                    stop = re.compile(rf"</{element[2]}\s*>", re.I).search(text, end)
                    end = stop.end() if stop else end
        elif sign in ("{{", "{|"):
            end = _closing(text, i, sign, "}}" if sign == "{{" else "|}")
        elif sign == "[" and text.startswith("[[", i):
            end = _closing(text, i, "[[", "]]")
            if end > 0:
                target, _, label = text[i + 2 : end - 2].partition("|")
                if target.split(":")[0].strip().lower() not in NAMESPACES or ":" not in target:
                    out.append(_unmarked(label or target))
        elif sign == "[" and (outer := re.compile(r"\[https?://\S*?(?:\s+([^\]]*))?\]").match(text, i)):
            out.append(outer[1] or "")
            end = outer.end()
        elif sign == "''":
            end = i + (3 if text.startswith("'''", i) else 2)
        elif sign.startswith("__"):
            end = jump.end()
        if end < 0:
            out.append(text[i])
            end = i + 1
        i = end
    return "".join(out)


def wikitext(text: str) -> str:
    """Plain text of wiki markup: comments, references, templates, tables, files and magic words go, links keep their label."""
    lines = []
    for line in _unmarked(text).split("\n"):
        line = line.lstrip("#*:;")
        bare = line.strip()
        if bare.startswith("=") and bare.endswith("=") and bare.strip("= "):
            line = bare.strip("=")
        lines.append(re.sub(r"[ \t]+", " ", html.unescape(line)).strip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def wiki_links(text: str, most: int = 80) -> list[str]:
    """Titles linked from wiki markup, first seen first, without namespaces."""
    found = (m.split("|")[0].split("#")[0].strip() for m in re.findall(r"\[\[([^\[\]]+)\]\]", text))
    return list(dict.fromkeys(t for t in found if t and ":" not in t))[:most]


def responses(rows: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """`keep` columns with content_type and html of archive records (binary); a record that is no page, or broken, gives nulls."""

    def read(data):
        found = [archive_response(x) if x is not None else None for x in data]
        return [{"content_type": f[0] if f else None, "html": f[1] if f else None} for f in found]

    return rows.select(*keep, column(read, "struct<content_type: string, html: string>")(record).alias("_r")).select(*keep, "_r.content_type", "_r.html")


def dechunked(body):
    """A column of bodies (binary) without their chunked transfer coding."""

    return column(lambda data: [None if x is None else dechunk(x) for x in data], "binary")(body)


def fetchable(rows: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Index rows whose record may be fetched: a length over 0 and up to `most`."""
    return rows.where((F.col("length") > 0) & (F.col("length") <= most))


def discovered(rows: DataFrame, key: str = "urlkey") -> DataFrame:
    """Index rows of pages that were answered, the first of each key."""
    good = rows.where("status = '200' and lower(mime) = 'text/html'")
    return good.groupBy(key).agg(F.min(F.struct("timestamp", F.struct(*good.columns).alias("r"))).alias("m")).select("m.r.*")


def may_fetch(urls: DataFrame, sites: DataFrame, agent: str) -> DataFrame:
    """`urls` (host, path, ...) with `allowed` by the robots text of their host (sites: host, text); without a text all is allowed."""

    @F.pandas_udf("boolean")
    def judge(text: pd.Series, path: pd.Series) -> pd.Series:
        rules: dict = {}
        for t in text.unique():
            rules[t] = robots_rules(t or "", agent)
        return pd.Series([allowed(rules[t], p or "/") for t, p in zip(text, path, strict=True)])

    return urls.join(sites, "host", "left").withColumn("allowed", judge("text", "path")).drop("text")


def prefix_allowed(text, path):
    """The plainer check, as a column: no Disallow line of the group for all is a prefix of the path."""
    lines = F.split(text, r"\r?\n")
    start = F.struct(F.lit("*").alias("agent"), F.lit(True).alias("ok"))

    def step(state, line):
        low = F.lower(F.trim(line))
        value = F.trim(F.regexp_replace(F.trim(line), r"^[^:]*:", ""))
        agent = F.when(low.startswith("user-agent:"), value).otherwise(state["agent"])
        hit = low.startswith("disallow:") & (value != "") & (agent == "*") & F.startswith(path, value)
        return F.struct(agent.alias("agent"), (state["ok"] & ~hit).alias("ok"))

    return F.aggregate(F.filter(lines, lambda x: ~F.trim(x).startswith("#")), start, step)["ok"]
