"""URL keys and predicates, date ladders."""

from __future__ import annotations

from lodestar.operators.dialect import corpus, micro, operator

AS_OF = "DATE '2024-06-30'"


def host(d, u: str) -> str:
    return d.replace(f"lower({d.first(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)})", r"^www\.|:[0-9]+$", "")


def path(d, u: str) -> str:
    return d.first(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


@operator("url_1")
def hosts(d):
    return f"SELECT page_id, {host(d, 'url')} AS host FROM pages"


@operator("url_2")
def keys(d):
    return f"SELECT page_id, concat({host(d, 'url')}, {d.replace(path(d, 'url'), '/+$', '')}) AS url_key FROM pages"


@operator("url_3")
def normal(d):
    """Without the fragment, query parameters sorted, the first value of each, blanks dropped."""
    base, q = d.replace("url", r"[?#].*$", ""), d.first("url", r"\?([^#]*)", 1)
    sort = "list_sort" if d.name == "check" else "array_sort"
    return f"""WITH u AS (SELECT page_id, concat(url, CASE WHEN page_id % 2 = 0 THEN '?b=2&a=1&c=#x' ELSE '#top' END) AS url FROM pages), p AS (SELECT page_id, {base} AS base, {sort}({d.where(d.split(q, '&'), d.matches('x', '=.'))}) AS ps FROM u)
SELECT page_id, CASE WHEN {d.size('ps')} > 0 THEN concat(base, '?', {d.join('ps', '&')}) ELSE base END AS url FROM p"""


@operator("url_4")
def netloc(d):
    return f"SELECT page_id, {d.first('url', '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)} AS netloc FROM pages"


@operator("url_5")
def links(d):
    """Internal and external links of each page; relative links are internal, nofollow is left out."""
    hrefs = d.map(d.where(d.all("html", '<a [^>]*>'), f"NOT {d.matches('x', 'nofollow')}"), d.first("x", 'href="([^"]*)"', 1))
    each = d.each("page_id, url", "c", "hs", "h", "pos")
    return f"""WITH c AS (SELECT page_id, url, {hrefs} AS hs FROM pages), l AS ({each})
SELECT page_id, cast(sum(CASE WHEN NOT {d.matches('h', '^[a-z]+:')} OR {host(d, 'h')} = {host(d, 'url')} THEN 1 ELSE 0 END) AS bigint) AS internal,
  cast(sum(CASE WHEN {d.matches('h', '^https?:')} AND {host(d, 'h')} <> {host(d, 'url')} THEN 1 ELSE 0 END) AS bigint) AS external FROM l WHERE h <> '' GROUP BY page_id"""


@operator("url_6")
def trust(d):
    """Trust of the first table row whose domain the host ends with, else 0.5."""
    t = d.values("t", "domain, trust, place", [["'src0.example'", "0.9e0", "1"], ["'src1.example'", "0.8e0", "2"], ["'example'", "0.6e0", "3"]])
    return f"""WITH {corpus(d)}, {t}, m AS (SELECT id, trust, row_number() OVER (PARTITION BY id ORDER BY place) AS rn FROM corpus JOIN t ON {d.suffix(host(d, 'url'), 'domain')})
SELECT c.id, {micro('coalesce(trust, 0.5)')} AS trust FROM corpus c LEFT JOIN m ON c.id = m.id AND rn = 1"""


def dated(d) -> str:
    """Items with a publication date as text, blank for every seventh."""
    day = "CAST(DATE '2020-01-01' + CAST(doc_id % 1700 AS INT) AS STRING)" if d.name == "spark" else "CAST(DATE '2020-01-01' + CAST(doc_id % 1700 AS INT) AS VARCHAR)"
    return f"dated AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {day} END AS published FROM documents)"


@operator("fil_6")
def since(d):
    whens = ", ".join(f"CAST({AS_OF} - {f'INTERVAL {n} DAY'} AS DATE) AS d{n}" for n in (1, 7, 31, 365))
    return f"WITH {dated(d)}, b AS (SELECT {whens}) SELECT cast(count(CASE WHEN published >= cast(d1 AS string) THEN 1 END) AS bigint) AS day, cast(count(CASE WHEN published >= cast(d31 AS string) THEN 1 END) AS bigint) AS month, cast(count(CASE WHEN published >= cast(d365 AS string) THEN 1 END) AS bigint) AS year FROM dated CROSS JOIN b WHERE published <> ''"


@operator("fil_20")
def crawlable(d):
    return f"SELECT page_id, {d.matches('lower(url)', '^https?://[^/]+')} AND NOT {d.matches('lower(url)', '[.](jpg|png|gif|pdf|zip|exe|mp4|css|js)([?#]|$)')} AND NOT {d.matches('lower(url)', '[?&](download|attachment)=')} AS ok FROM pages"


@operator("fil_21")
def content_type(d):
    case = " ".join(f"WHEN {d.matches('lower(url)', '[.](' + e + ')([?#]|$)')} THEN '{k}'" for k, e in (("document", "pdf|docx?|txt"), ("image", "jpe?g|png|gif|svg"), ("video", "mp4|webm|avi"), ("audio", "mp3|wav|ogg")))
    return f"SELECT page_id, CASE {case} ELSE 'webpage' END AS kind FROM pages"


@operator("fil_22")
def social(d):
    return f"SELECT page_id, {d.matches(host(d, 'url'), 'facebook|twitter|instagram|linkedin|youtube|tiktok|example[.]org')} AS social FROM pages"


@operator("fil_23")
def spam(d):
    return f"WITH {corpus(d)} SELECT id, {d.matches('lower(concat(url, title))', 'casino|viagra|loan|porn|poker|pills|cheap|src1[.]')} AS spam FROM corpus"


@operator("fil_24")
def screen(d):
    """Deny by host suffix and disclosure, then the first of each URL key."""
    key = f"concat({host(d, 'url')}, {d.replace(path(d, 'url'), '/+$', '')})"
    return f"""WITH {corpus(d)}, k AS (SELECT id, {key} AS url_key, row_number() OVER (PARTITION BY {key} ORDER BY id) AS rn FROM corpus WHERE NOT {d.suffix(host(d, 'url'), chr(39) + 'src5.example' + chr(39))} AND NOT {d.matches('lower(content)', 'ai[ -]generated|as an ai')})
SELECT id, url_key FROM k WHERE rn = 1"""


@operator("dt_3")
def freshness(d):
    age = d.days(AS_OF, d.try_date("published"))
    return f"WITH {dated(d)} SELECT id, {micro(f'CASE WHEN published = {chr(39) * 2} THEN 0.5 WHEN {age} <= 30 THEN 1.0 WHEN {age} <= 180 THEN 0.8 WHEN {age} <= 365 THEN 0.6 WHEN {age} <= 730 THEN 0.4 ELSE 0.3 END')} AS freshness FROM dated"


@operator("dt_4")
def decayed(d):
    age = d.days(AS_OF, d.try_date("published"))
    return f"WITH {dated(d)} SELECT id, {micro(f'0.5 * pow(2.0, -{age} / 180e0) + 0.25 * 0.5 + 0.25 * pow(2.0, -{age} / 90e0)')} AS score FROM dated WHERE published <> ''"


@operator("dt_5")
def exponential(d):
    age = d.days(AS_OF, d.try_date("published"))
    return f"WITH {dated(d)} SELECT id, {micro(f'CASE WHEN published = {chr(39) * 2} OR {age} < 0 THEN 0.5 ELSE greatest(0.1, exp(-{age} / 365e0)) END')} AS freshness FROM dated"


@operator("dt_6")
def by_vertical(d):
    age = d.days(AS_OF, d.try_date("published"))
    return f"WITH {dated(d)} SELECT id, {micro(f'greatest(0.1, exp(-greatest({age}, 0) / (CASE id % 3 WHEN 0 THEN 14e0 WHEN 1 THEN 365e0 ELSE 730e0 END)))')} AS factor FROM dated WHERE published <> ''"


@operator("dt_10")
def busiest_hour(d):
    return "WITH h AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY event_type, hour(ts)), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, h) AS rn FROM h) SELECT event_type, cast(h AS bigint) AS hour, n FROM k WHERE rn = 1"
