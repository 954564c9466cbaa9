"""Queries that apply the table operators to tables made from the driver's, each with SQL written apart from it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestar.operators import measure, merge, select, sinks
from lodestar.operators.store import folder
from lodestar.session import TABLES, table

#: The tables that operators work on, from the driver's; the same text runs on both engines.
VIEWS = {
    "items": """SELECT d.doc_id AS id, concat('https://', d.source, '.example/', CASE WHEN d.doc_id % 3 = 0 THEN 'a.html' ELSE 'b.pdf' END, '?', d.doc_id) AS url,
      substr(split_part(d.text, chr(10), 1), 1, 80) AS title, d.text AS content, d.lang AS language, d.source AS source_name,
      CASE d.doc_id % 4 WHEN 0 THEN 'science_research' WHEN 1 THEN 'programming_engineering' WHEN 2 THEN '' ELSE 'data_economics' END AS category,
      cast(coalesce(l.quality, 0.5) AS double) AS quality, cast(d.doc_id % 101 AS double) / 100 AS authority, cast(d.doc_id * 7 % 101 AS double) / 100 AS freshness,
      CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE cast(DATE '2020-01-01' + cast(d.doc_id % 1700 AS int) AS string) END AS published, cast(d.doc_id * 13 % 997 AS double) / 997 AS overall_rank
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "links": """SELECT l_orderkey * 10 + l_linenumber AS id, concat('https://s', l_suppkey % 40, CASE WHEN l_suppkey % 3 = 0 THEN '.blog' ELSE '' END, '.example/', l_suppkey) AS source_url,
      CASE WHEN l_partkey % 50 = 0 THEN 'mailto:x' ELSE concat('https://www.p', l_partkey % 60, '.example/', l_partkey) END AS target_url, l_returnflag = 'R' AS nofollow, cast(l_quantity AS double) AS authority, l_shipdate AS seen FROM lineitem""",
    "sessions": "SELECT c_custkey AS session_id, c_name AS name, c_mktsegment AS kind FROM customer",
    "visits": """SELECT o_orderkey AS id, o_custkey AS session_id, concat('https://w', o_custkey % 50, '.example/', o_orderkey) AS url, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 ELSE 500 END AS status,
      o_orderdate AS crawled_at, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 1000 END AS content_hash, o_orderpriority AS source, cast(o_totalprice AS double) AS size FROM orders""",
    "shards": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS kind, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE cast(s_suppkey * 37 % 101 AS double) END AS used FROM supplier",
    "logs": "SELECT event_id AS id, event_type AS level, user_id, ts FROM events",
    "seeds": "SELECT c_custkey AS id, concat('https://w', c_custkey % 50, '.example/') AS url, c_custkey % 5 AS priority, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 11 END AS last_crawled FROM customer",
    "sources": """SELECT s_suppkey AS id, concat('src', s_suppkey % 70) AS name, CASE s_suppkey % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'docs' ELSE 'wiki' END AS kind, s_suppkey % 4 + 1 AS priority,
      cast(s_suppkey % 100 AS double) / 100 AS quality, s_suppkey % 2 = 0 AS has_api FROM supplier""",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
}

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for t in TABLES:
            table(spark, sf_dir, t).createOrReplaceTempView(t)

    def __getattr__(self, name: str):
        return self.spark.sql(VIEWS[name]) if name in VIEWS else self.spark.table(name)

    def place(self, name: str) -> str:
        import uuid

        return f"{folder(self.spark)}/{name}-{uuid.uuid4().hex}"


def with_views(sql: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b(FROM|JOIN) {v}\b", sql)]
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    return sql if not used else f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def micro(c):
    return F.floor(c * 1_000_000 + 0.5).cast("long")


def m(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5)::BIGINT"


HOST = "regexp_replace(regexp_extract(lower({}), '^[a-z]+://([^/?#]*)', 1), '^www[.]', '')"
NOW = "(SELECT max(ts) FROM logs)"


def now(t):
    return t.logs.agg(F.max("ts")).first()[0]


# upserts
@query("ups_1", "WITH n AS (SELECT id + 20 AS id, concat('new ', title) AS title, quality >= 0.5 AS ok FROM items WHERE id % 2 = 0), g AS (SELECT * FROM n WHERE ok) SELECT coalesce(g.id, i.id) AS id, CASE WHEN g.id IS NULL THEN i.title ELSE g.title END AS title FROM items i FULL JOIN g ON i.id = g.id")
def _(t):
    new = t.items.where("id % 2 = 0").select((F.col("id") + 20).alias("id"), F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("id") % 3 == 0, F.col("quality") >= 0.5).alias("verdict"), "quality")
    return merge.gated_upsert(t.items.select("id", "title"), new, "id", "verdict", F.col("quality") >= 0.5)[0]


@query("ups_2", "WITH r AS (SELECT source_name AS url, id, string_split(content, ' ')[1:25] AS signals, row_number() OVER (PARTITION BY source_name ORDER BY id DESC) AS rn FROM items) SELECT url, id, array_to_string(signals, ' ') AS signals FROM r WHERE rn = 1")
def _(t):
    rows = t.items.select(F.col("source_name").alias("url"), "id", F.split("content", " ").alias("signals"))
    return merge.audit(rows, "url", "signals", ["id"]).withColumn("signals", F.array_join("signals", " "))


@query("ups_3", "SELECT user_id, arg_max(level, id) AS level, max(id) AS id FROM logs GROUP BY user_id")
def _(t):
    return merge.last_wins(t.logs.select("user_id", "level", "id"), ["user_id"], ["id"])


@query("ups_4", "WITH u AS (SELECT source_url, target_url, min(id) AS f FROM links WHERE target_url LIKE 'http%' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY f, target_url) AS place FROM u) SELECT source_url, target_url, place::INT AS place FROM k WHERE place <= 100")
def _(t):
    return merge.outbound_links(t.links, "source_url", "target_url", "id")


@query("ups_5", "SELECT DISTINCT kind AS term, source_name AS related FROM items JOIN sources ON name = source_name")
def _(t):
    rows = t.sources.join(t.items, F.col("name") == F.col("source_name")).select(F.col("kind").alias("term"), F.col("source_name").alias("related")).distinct()
    place = t.place("thesaurus")
    sinks.write_parquet(rows.limit(3), place)
    return sinks.write_parquet(rows, place)


@query("ups_6", f"SELECT source, count(size) AS n, {m('avg(size) / 1000')} AS mean FROM visits GROUP BY source")
def _(t):
    return merge.running_mean(t.visits, "source", "size").select("source", "n", micro(F.col("mean") / 1000).alias("mean"))


@query("ups_7", "SELECT lower(level) AS query, count(*) AS n, max(ts) AS last_seen FROM logs WHERE length(level) >= 2 GROUP BY 1")
def _(t):
    return merge.query_counter(t.logs.withColumn("level", F.concat(F.lit("  "), F.upper("level"), F.lit(" "))), "level", "ts")


@query("ups_8", "WITH n AS (SELECT id + 5 AS id, session_id + 1 AS session_id, 999 AS status, concat(url, '#') AS url FROM visits WHERE id % 3 = 0) SELECT coalesce(v.id, n.id) AS id, coalesce(v.session_id, n.session_id) AS session_id, CASE WHEN n.id IS NULL THEN v.status ELSE n.status END AS status, CASE WHEN n.id IS NULL THEN v.url ELSE n.url END AS url FROM visits v FULL JOIN n ON v.id = n.id")
def _(t):
    old = t.visits.select("id", "session_id", "status", "url")
    new = old.where("id % 3 = 0").selectExpr("id + 5 AS id", "session_id + 1 AS session_id", "999 AS status", "concat(url, '#') AS url")
    return merge.upsert(old, new, ["id"], update=["status", "url"])


@query("ups_9", "SELECT source_url, target_url, count(*) AS n FROM (SELECT source_url, target_url FROM links UNION ALL SELECT source_url, target_url FROM links WHERE id % 10 = 1) x GROUP BY ALL")
def _(t):
    both = t.links.select("source_url", "target_url")
    return both.unionByName(t.links.where("id % 10 = 1").select("source_url", "target_url")).groupBy("source_url", "target_url").agg(F.count("*").alias("n"))


@query("ups_10", "SELECT source_url, target_url, max(id) AS id FROM links GROUP BY ALL")
def _(t):
    return merge.last_wins(t.links.select("source_url", "target_url", "id"), ["source_url", "target_url"], ["id"])


@query("ups_11", f"WITH n AS (SELECT {HOST.format('source_url')} AS host, count(*) AS score FROM links WHERE nofollow GROUP BY 1), o AS (SELECT DISTINCT {HOST.format('source_url')} AS host, 0 AS score FROM links) SELECT o.host, coalesce(n.score, o.score)::BIGINT AS score FROM o LEFT JOIN n ON n.host = o.host")
def _(t):
    hosts = t.links.select(select.host(F.col("source_url")).alias("host"), "nofollow")
    old = hosts.select("host", F.lit(0).cast("long").alias("score")).distinct()
    return merge.upsert(old, hosts.where("nofollow").groupBy("host").agg(F.count("*").alias("score")), ["host"])


@query("ups_12", "WITH n AS (SELECT session_id, count(*) AS n FROM visits GROUP BY 1) SELECT s.session_id, s.name, CASE WHEN n.n > 12 THEN 'BUSY' ELSE s.kind END AS kind FROM sessions s LEFT JOIN n ON n.session_id = s.session_id")
def _(t):
    busy = t.visits.groupBy("session_id").agg(F.when(F.count("*") > 12, "BUSY").alias("kind"))
    return merge.update_columns(t.sessions, busy, ["session_id"], ["kind"])


@query("ups_13", "WITH o AS (SELECT id, 1 AS crawl_count FROM seeds WHERE id % 2 = 0), a AS (SELECT * FROM o UNION ALL SELECT id, 0 FROM seeds WHERE id % 2 <> 0), h AS (SELECT session_id, count(*) AS n FROM visits GROUP BY 1) SELECT id, (crawl_count + coalesce(n, 0))::BIGINT AS crawl_count FROM a LEFT JOIN h ON id = session_id")
def _(t):
    old = t.seeds.where("id % 2 = 0").select("id", F.lit(1).cast("long").alias("crawl_count"))
    every = merge.insert_ignore(old, t.seeds.select("id", F.lit(0).cast("long").alias("crawl_count")), ["id"])
    return merge.increment(every, t.visits.select(F.col("session_id").alias("id")), ["id"], "crawl_count")


@query("del_1", "SELECT id FROM visits WHERE crawled_at >= TIMESTAMP '1995-06-01'")
def _(t):
    import datetime

    return merge.delete_older(t.visits, "crawled_at", datetime.datetime(1995, 6, 1)).select("id")


@query("del_3", "WITH k AS (SELECT id, row_number() OVER (ORDER BY crawled_at, id) AS rn FROM visits) SELECT id, CASE WHEN rn <= 100 THEN 'cold' ELSE 'hot' END AS db_name FROM k")
def _(t):
    return merge.move_oldest(t.visits.withColumn("db_name", F.lit("hot")), "crawled_at", "id", 100, "db_name", "cold").select("id", "db_name")


@query("mnt_1", f"""WITH a AS (SELECT id, max(published) AS d FROM items WHERE id % 5 = 0 AND published <> '' GROUP BY 1), b AS (SELECT id + 7 AS id, max(published) AS d FROM items WHERE published <> '' GROUP BY 1),
f AS (SELECT i.*, CASE WHEN i.published = '' THEN coalesce(a.d, b.d) END AS found FROM items i LEFT JOIN a ON a.id = i.id LEFT JOIN b ON b.id = i.id), g AS (SELECT *, CASE WHEN found IS NULL THEN freshness WHEN found >= '2023-01-01' THEN 1.0 ELSE 0.3 END AS fresh FROM f)
SELECT id, coalesce(found, published) AS published, {m('fresh')} AS freshness, {m('CASE WHEN found IS NULL THEN overall_rank ELSE greatest(0, least(1, overall_rank + 0.15 * (fresh - freshness))) END')} AS overall_rank FROM g""")
def _(t):
    first, second = t.items.where("id % 5 = 0").select("id", "published"), t.items.select((F.col("id") + 7).alias("id"), "published")
    fresh = lambda d: F.when(d >= "2023-01-01", 1.0).otherwise(0.3)
    out = merge.backfill_dates(t.items, [first, second], "id", "published", "freshness", "overall_rank", fresh)
    return out.select("id", "published", micro(F.col("freshness")).alias("freshness"), micro(F.col("overall_rank")).alias("overall_rank"))


@query("mnt_4", "SELECT id, title, substr(content, 1, 320) AS snippet, coalesce(category, '') AS category FROM items WHERE quality >= 0.5 ORDER BY overall_rank DESC, id LIMIT 5000")
def _(t):
    return t.items.where("quality >= 0.5").orderBy(F.desc("overall_rank"), "id").limit(5000).select("id", "title", F.substring("content", 1, 320).alias("snippet"), F.coalesce("category", F.lit("")).alias("category"))


@query("mnt_5", "SELECT id, title FROM items WHERE id % 2 = 1")
def _(t):
    root = t.place("index")
    sinks.swap(t.items.where("id % 2 = 0").select("id", "title"), root)
    sinks.swap(t.items.where("id % 2 = 1").select("id", "title"), root)
    return sinks.current(t.spark, root)


# sinks
@query("snk_1", "SELECT id, title, source_name, published FROM items")
def _(t):
    return sinks.write_json_lines(t.items.select("id", "title", "source_name", "published"), t.place("lines"))


@query("snk_2", "SELECT id, md5(content) AS content, quality FROM items")
def _(t):
    return sinks.write_parquet(t.items.select("id", F.md5("content").alias("content"), "quality"), t.place("archive"))


@query("snk_3", "SELECT CASE WHEN category = '' THEN 'unknown' ELSE category END AS category, count(*) AS n FROM items GROUP BY 1")
def _(t):
    named = t.items.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))).select("id", "category")
    return sinks.category_counts(sinks.write_parquet(named, t.place("split"), ["category"]))


@query("snk_4", "SELECT id, url, coalesce(title, '') AS title, md5(coalesce(content, '')) AS content, coalesce(language, 'en') AS language, source_name, category, quality, authority, freshness, published, overall_rank FROM items")
def _(t):
    return sinks.archive_rows(t.items).withColumn("content", F.md5("content"))


@query("snk_5", "SELECT id, length(html) AS n FROM (SELECT page_id AS id, html FROM pages)")
def _(t):
    return sinks.write_parquet(t.pages.select(F.col("page_id").alias("id"), "html"), t.place("raw")).select("id", F.length("html").cast("long").alias("n"))


@query("snk_6", "SELECT id, url, title, md5(content) AS content, category, published FROM items")
def _(t):
    return sinks.backup(t.items, t.place("backup")).select("id", "url", "title", F.md5("content").alias("content"), "category", "published")


@query("snk_7", "SELECT id, CASE WHEN quality >= 0.5 THEN title ELSE 'old' END AS title FROM items WHERE id % 3 = 0 OR quality >= 0.5")
def _(t):
    place = t.place("backup")
    sinks.backup(t.items, place)
    return sinks.restore(t.spark, place, t.items.where("id % 3 = 0").withColumn("title", F.lit("old")), F.col("quality") >= 0.5).select("id", "title")


@query("snk_8", "WITH f AS (SELECT id, row_number() OVER (PARTITION BY source ORDER BY crawled_at DESC, id DESC) AS rn FROM visits) SELECT id FROM f WHERE rn > 10")
def _(t):
    return merge.retain(t.visits, [F.desc("crawled_at"), F.desc("id")], 10, ["source"]).select("id")


@query("snk_9", "SELECT id, 1 AS version FROM items WHERE id < 50 UNION ALL SELECT id, 2 FROM items")
def _(t):
    root = t.place("versions")
    one, two = sinks.snapshot(t.items.where("id < 50").select("id"), root, 1), sinks.snapshot(t.items.select("id"), root, 2)
    return one.withColumn("version", F.lit(1)).unionByName(two.withColumn("version", F.lit(2)))


# scans
@query("src_3", "SELECT id, url, status FROM visits WHERE size > 100000 ORDER BY id LIMIT 200 OFFSET 50")
def _(t):
    return t.visits.where("size > 100000").orderBy("id").offset(50).limit(200).select("id", "url", "status")


@query("src_16", "SELECT session_id, id FROM visits WHERE EXISTS (SELECT 1 FROM seeds WHERE seeds.id = session_id AND priority = 3)")
def _(t):
    return select.keep_known(t.visits, t.seeds.where("priority = 3"), "session_id", "id").select("session_id", "id")


@query("src_19", "WITH u AS (SELECT session_id, status, min(id) AS id, max(crawled_at) AS at FROM visits GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM u) SELECT session_id, status, id FROM k WHERE rn <= 2")
def _(t):
    first = merge.first_wins(t.visits.select("session_id", "status", "id"), ["session_id", "status"], ["id"])
    return select.cap(first, ["session_id"], [F.col("id")], 2)


@query("src_22", "WITH u AS (SELECT kind, name, min(id) AS id FROM sources GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM u) SELECT kind, name, id FROM k WHERE rn <= 4")
def _(t):
    return select.cap(merge.first_wins(t.sources.select("kind", "name", "id"), ["kind", "name"], ["id"]), ["kind"], [F.col("id")], 4)


@query("src_26", "SELECT id, CASE WHEN kind IN ('news', 'docs') THEN kind ELSE 'knowledge_foundations' END AS category, coalesce(quality, 0) AS quality FROM sources")
def _(t):
    known = t.spark.createDataFrame([("news", "news"), ("docs", "docs")], "k string, v string")
    return select.with_default(t.sources, known, "kind", "k", "v", "knowledge_foundations", "category").select("id", "category", F.coalesce("quality", F.lit(0.0)).alias("quality"))


@query("src_27", "WITH n AS (SELECT id, concat('src', id % 90) AS name, kind FROM sources), x AS (SELECT * FROM n WHERE name NOT IN (SELECT name FROM sources)) SELECT id, name, CASE kind WHEN 'news' THEN 0.9 WHEN 'docs' THEN 0.8 ELSE 0.85 END::DOUBLE AS quality FROM x")
def _(t):
    quality = t.spark.createDataFrame([("news", 0.9), ("docs", 0.8)], "k string, v double")
    new = select.drop_known(t.sources.select("id", F.concat(F.lit("src"), F.col("id") % 90).alias("name"), "kind"), t.sources, "name", "name")
    return select.with_default(new, quality, "kind", "k", "v", 0.85, "quality").select("id", "name", "quality")


@query("src_28", "SELECT target_url AS url, min(id) AS first FROM links WHERE target_url LIKE 'http%' GROUP BY 1")
def _(t):
    lists = t.links.groupBy("source_url").agg(F.collect_list(F.struct("id", F.col("target_url").alias("url"))).alias("urls"))
    rows = lists.select(F.inline("urls")).where(F.col("url").rlike("^https?://"))
    return rows.groupBy("url").agg(F.min("id").alias("first"))


@query("src_31", "SELECT level, user_id, max(id) AS id FROM logs GROUP BY ALL")
def _(t):
    return merge.last_wins(t.logs.select("level", "user_id", "id"), ["level", "user_id"], ["id"])


@query("src_32", f"WITH k AS (SELECT level, id, row_number() OVER (PARTITION BY level ORDER BY ts DESC, id) AS rn FROM logs WHERE ts >= {NOW} - INTERVAL 24 HOUR) SELECT level, id FROM k WHERE rn <= 20")
def _(t):
    return select.cap(t.logs.where(select.within(F.col("ts"), now(t), 24)), ["level"], [F.desc("ts"), F.col("id")], 20).select("level", "id")


@query("src_35", "SELECT id, md5(content) AS content_hash, md5(substr(content, 1, 5000)) AS content FROM items WHERE length(content) >= 50")
def _(t):
    return t.items.where(F.length("content") >= 50).select("id", F.md5("content").alias("content_hash"), F.md5(F.substring("content", 1, 5000)).alias("content"))


# filters
H, P = HOST.format("url"), "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("fil_3", f"SELECT id FROM items WHERE {H} = 'src3.example' OR suffix({H}, '.src3.example')")
def _(t):
    return t.items.where(select.at_site(F.col("url"), "WWW.src3.example".lower())).select("id")


@query("fil_4", f"SELECT id FROM items WHERE suffix(lower({P}), '.html')")
def _(t):
    return t.items.where(select.of_type(F.col("url"), "HTML")).select("id")


@query("fil_5", "SELECT id, published FROM items WHERE published <> '' AND published >= '2021-02-01' AND published <= '2023-02-31'")
def _(t):
    return t.items.where(select.between_dates(F.col("published"), "2021-02-01", "2023-02-31")).select("id", "published")


@query("fil_7", "SELECT id FROM items WHERE NOT (contains(lower(concat_ws(' ', title, content)), 'thing') OR contains(lower(concat_ws(' ', title, content)), 'eau'))")
def _(t):
    return t.items.where(~select.holds_any([F.col("title"), F.col("content")], ["Thing", "eau"])).select("id")


@query("fil_8", f"SELECT id FROM items WHERE ({H} = 'src4.example' OR {H} = 'src5.example') AND suffix({P}, '.pdf') AND published >= '2021-01-01' AND NOT contains(lower(concat_ws(' ', title, content)), 'idiot')")
def _(t):
    return t.items.where(select.passes(F.col("url"), F.col("published"), [F.col("title"), F.col("content")], sites=["src4.example", "src5.example"], types=["pdf"], after="2021-01-01", excluded=["idiot"])).select("id")


@query("fil_9", "SELECT id FROM items WHERE category = 'data_economics' ORDER BY overall_rank DESC, id LIMIT 40")
def _(t):
    return t.items.where(F.col("category") == "data_economics").orderBy(F.desc("overall_rank"), "id").limit(40).select("id")


@query("fil_10", "SELECT id FROM items WHERE contains(lower(concat(title, ' ', substr(content, 1, 320))), 'the') AND contains(lower(concat(title, ' ', substr(content, 1, 320))), 'ing')")
def _(t):
    return t.items.where(select.holds_all([F.col("title"), F.substring("content", 1, 320)], ["The", "ing", "a"])).select("id")


@query("fil_11", "SELECT id FROM items WHERE contains(lower(title), 'heit') OR contains(lower(content), 'heit') OR contains(lower(source_name), 'heit') OR contains(lower(title), 'ción') OR contains(lower(content), 'ción')")
def _(t):
    return t.items.where(select.any_of([F.contains(F.lower(c), F.lit(w)) for c in ("title", "content", "source_name") for w in ("heit", "ción")])).select("id")


@query("fil_12", "SELECT id FROM items WHERE title ILIKE '%thing%' OR content ILIKE '%thing%' ORDER BY id LIMIT 100")
def _(t):
    return select.page(t.items.where(F.col("title").ilike("%thing%") | F.col("content").ilike("%thing%")), [F.col("id")], 100).select("id")


@query("fil_13", "SELECT id FROM links WHERE contains(lower(target_url), 'p7.example')")
def _(t):
    return t.links.where(F.col("target_url").ilike("%p7.example%")).select("id")


@query("fil_14", "SELECT id, status FROM visits WHERE status = 200 ORDER BY id LIMIT 100 OFFSET 100")
def _(t):
    return select.page(t.visits.where("status = 200"), [F.col("id")], 100, 2).select("id", "status")


@query("fil_15", f"SELECT id FROM logs WHERE ts >= {NOW} - INTERVAL 24 HOUR UNION ALL SELECT id FROM links WHERE authority >= 50")
def _(t):
    return t.logs.where(select.within(F.col("ts"), now(t), 24)).select("id").union(t.links.where("authority >= 50").select("id"))


@query("fil_16", "SELECT DISTINCT content_hash FROM visits WHERE content_hash IS NOT NULL")
def _(t):
    return select.known_values(t.visits, "content_hash")


@query("fil_17", "SELECT status, count(*) AS n FROM visits GROUP BY status")
def _(t):
    t.visits.createOrReplaceTempView("visits_view")
    return select.read_only(t.spark, " select status, count(*) AS n FROM visits_view GROUP BY status; ")


@query("fil_25", f"SELECT id FROM items WHERE {H} IN ('src1.example', 'src2.example') OR suffix({H}, '.src1.example') OR suffix({H}, '.src2.example')")
def _(t):
    return t.items.where(select.on_list(select.host(F.col("url")), ["src1.example", "src2.example"])).select("id")


@query("fil_26", f"SELECT id FROM items WHERE url LIKE 'https://%' AND ({H} = 'example' OR suffix({H}, '.example'))")
def _(t):
    return t.items.where(select.audio_allowed(F.col("url"), ["example"])).select("id")


@query("fil_28", "SELECT id FROM sources WHERE kind = 'docs' AND priority <= 2 AND NOT has_api")
def _(t):
    return t.sources.where((F.col("kind") == "docs") & (F.col("priority") <= 2) & ~F.col("has_api")).select("id")


@query("fil_29", "SELECT id, level FROM logs WHERE level = 'click' ORDER BY ts DESC, id DESC LIMIT 100")
def _(t):
    return select.page(t.logs.where(F.col("level") == "click"), [F.desc("ts"), F.desc("id")], 100).select("id", "level")


@query("fil_30", "WITH n AS (SELECT id + 3 AS id, CASE WHEN id % 3 = 0 THEN content_hash ELSE content_hash + 1 END AS h FROM visits) SELECT n.id, CASE WHEN o.id IS NULL THEN 'new' WHEN o.content_hash IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'updated' END AS change FROM n LEFT JOIN visits o ON o.id = n.id")
def _(t):
    new = t.visits.selectExpr("id + 3 AS id", "CASE WHEN id % 3 = 0 THEN content_hash ELSE content_hash + 1 END AS content_hash")
    return select.changes(t.visits, new, "id", "content_hash")


@query("fil_31", "SELECT id FROM seeds WHERE id NOT IN (SELECT session_id FROM visits WHERE status = 500)")
def _(t):
    return select.drop_known(t.seeds, t.visits.where("status = 500"), "id", "session_id").select("id")


@query("fil_32", "SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE concat('2024-01-', lpad((id % 28 + 1)::VARCHAR, 2, '0')) END AS next FROM seeds WHERE id % 5 < 2 OR id % 28 + 1 <= 15")
def _(t):
    rows = t.seeds.select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "soon").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).alias("next"))
    return select.due(rows, "next", "2024-01-15 12:00:00")


# joins
@query("jn_1", "SELECT i.id, i.language FROM items i WHERE contains(content, 'the ')")
def _(t):
    hits = t.items.where(F.contains("content", F.lit("the "))).select("id")
    return select.keep_known(t.items, hits, "id", "id").select("id", "language")


@query("jn_2", f"WITH r AS (SELECT id % 500 AS k, count(*) AS n FROM links WHERE nofollow GROUP BY 1) SELECT id, {m('coalesce(n, authority)')} AS authority FROM items LEFT JOIN r ON k = id")
def _(t):
    ranks = t.links.where("nofollow").groupBy((F.col("id") % 500).alias("id")).agg(F.count("*").cast("double").alias("authority"))
    return merge.update_columns(t.items, ranks, ["id"], ["authority"]).select("id", micro(F.col("authority")).alias("authority"))


@query("jn_3", "SELECT session_id FROM sessions WHERE session_id IN (SELECT session_id FROM visits WHERE size > 200000)")
def _(t):
    return select.keep_known(t.sessions, t.visits.where("size > 200000"), "session_id", "session_id").select("session_id")


@query("jn_4", "SELECT id, name FROM sources WHERE name IN ('src3', 'src8', 'src9')")
def _(t):
    return select.keep_known(t.sources, t.spark.createDataFrame([("src3",), ("src8",), ("src9",), ("none",)], "name string"), "name", "name").select("id", "name")


@query("jn_5", "SELECT DISTINCT source_name FROM items WHERE source_name NOT IN (SELECT name FROM sources)")
def _(t):
    return select.drop_known(t.items.select("source_name").distinct(), t.sources, "source_name", "name")


@query("jn_6", "SELECT id, CASE kind WHEN 'news' THEN 0.9 ELSE 0.85 END::DOUBLE AS quality FROM sources")
def _(t):
    return select.with_default(t.sources.drop("quality"), t.spark.createDataFrame([("news", 0.9)], "k string, v double"), "kind", "k", "v", 0.85, "quality").select("id", "quality")


@query("jn_7", "WITH e AS (SELECT id // 10 AS k, seen AS lastmod, row_number() OVER (PARTITION BY id // 10 ORDER BY id, seen) AS rn FROM links), e1 AS (SELECT * FROM e WHERE rn = 1) SELECT v.id, lastmod FROM visits v LEFT JOIN e1 ON k = v.id")
def _(t):
    entries = merge.first_wins(t.links.select(F.floor(F.col("id") / 10).alias("k"), "id", F.col("seen").alias("lastmod")), ["k"], ["id", "lastmod"]).select("k", "lastmod")
    return t.visits.join(entries, F.col("k") == F.col("id"), "left").select("id", "lastmod")


@query("jn_8", "SELECT id, CASE WHEN published = '' THEN '2024-05-01' ELSE published END AS published FROM items")
def _(t):
    return merge.update_columns(t.items, t.items.select("id", F.lit("2024-05-01").alias("published")), ["id"], ["published"], only_missing=True).select("id", "published")


@query("jn_9", f"SELECT id FROM links WHERE {HOST.format('target_url')} IN (SELECT concat('p', id % 60, '.example') FROM seeds WHERE priority = 4)")
def _(t):
    hosts = t.seeds.where("priority = 4").select(F.concat(F.lit("p"), F.col("id") % 60, F.lit(".example")).alias("host")).distinct()
    return select.keep_known(t.links.withColumn("h", select.host(F.col("target_url"))), hosts, "h", "host").select("id")


@query("jn_16", f"WITH l AS (SELECT DISTINCT target_url AS url FROM links WHERE {HOST.format('source_url')} = 's3.blog.example' AND target_url LIKE 'http%'), f AS (SELECT url FROM visits WHERE {H} = 'w3.example' AND url NOT IN (SELECT url FROM l)) SELECT url, 1 AS tier FROM l UNION ALL SELECT url, 2 FROM f")
def _(t):
    linked = t.links.where(select.at_site(F.col("source_url"), "s3.blog.example") & F.col("target_url").startswith("http")).select(F.col("target_url").alias("url")).distinct()
    same = t.visits.where(select.at_site(F.col("url"), "w3.example")).select("url")
    return select.append_new(linked.withColumn("tier", F.lit(1)), same.withColumn("tier", F.lit(2)), "url")


@query("jn_19", f"SELECT id FROM items WHERE NOT ({H} = 'src5.example' OR suffix({H}, '.src5.example'))")
def _(t):
    return t.items.where(~select.on_list(select.host(F.col("url")), ["src5.example"])).select("id")


@query("jn_20", "SELECT c_custkey AS id, n_name AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    return select.with_default(t.customer, t.nation, "c_nationkey", "n_nationkey", "n_name", "", "label").select(F.col("c_custkey").alias("id"), "label")


@query("jn_21", "WITH p AS (SELECT session_id AS k, count(*) AS n FROM visits GROUP BY 1), e AS (SELECT session_id AS k, count(*) AS n FROM visits WHERE status = 500 GROUP BY 1) SELECT session_id, coalesce(p.n, 0) AS pages, coalesce(e.n, 0) AS errors FROM sessions LEFT JOIN p ON p.k = session_id LEFT JOIN e ON e.k = session_id")
def _(t):
    return measure.session_stats(t.sessions.select("session_id"), t.visits, t.visits.where("status = 500"), "session_id", "session_id")


STATUS = "CASE WHEN used IS NULL OR used >= 90 THEN 'critical' WHEN used >= 75 THEN 'warning' ELSE 'healthy' END"


@query("jn_22", f"WITH s AS (SELECT *, {STATUS} AS status FROM shards), k AS (SELECT a.id AS from_shard, b.id AS to_shard, row_number() OVER (PARTITION BY a.id ORDER BY b.used, b.id) AS rn FROM s a JOIN s b ON a.kind = b.kind WHERE a.status <> 'healthy' AND b.status = 'healthy') SELECT from_shard, to_shard FROM k WHERE rn = 1")
def _(t):
    return measure.rotation(t.shards.withColumn("status", measure.health(F.col("used"))), "id", "kind", "used", "status")


@query("jn_23", "SELECT id FROM visits WHERE concat(session_id % 3, ':', id % 100) IN (SELECT concat(id % 3, ':', id % 100) FROM seeds WHERE priority = 1)")
def _(t):
    wanted = t.seeds.where("priority = 1").select((F.col("id") % 3).alias("stream"), (F.col("id") % 100).alias("title"))
    return t.visits.join(wanted, (F.col("session_id") % 3 == F.col("stream")) & (F.col("id") % 100 == F.col("title")), "left_semi").select("id")


# aggregates
@query("agg_1", f"WITH a AS (SELECT 'all' AS kind, '' AS name, count(*) AS n, 0 AS quality FROM items), b AS (SELECT 'category', category, count(*), 0 FROM items GROUP BY category), c AS (SELECT 'source', source_name, count(*), {m('avg(quality)')} FROM items GROUP BY source_name ORDER BY count(*) DESC, source_name LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def _(t):
    total, by, top = measure.index_stats(t.items, "category", "source_name", "quality")
    row = lambda df, kind, name, q: df.select(F.lit(kind).alias("kind"), name.alias("name"), "n", q.cast("long").alias("quality"))
    return row(total, "all", F.lit(""), F.lit(0)).union(row(by, "category", F.col("category"), F.lit(0))).union(row(top, "source", F.col("source_name"), micro(F.col("quality"))))


@query("agg_2", "SELECT count(*) AS n, count(*) FILTER (quality >= 0.95) AS high_quality, count(*) FILTER (priority = 1) AS priority_1, count(*) FILTER (priority = 2) AS priority_2, count(*) FILTER (priority = 3) AS priority_3 FROM sources")
def _(t):
    return measure.registry_stats(t.sources, "quality", "priority")


@query("agg_3", f"SELECT source, count(*) AS pages, count(*) FILTER (status = 500) AS errors, {m('avg(size) / 1000')} AS quality FROM visits GROUP BY source")
def _(t):
    return measure.run_stats(t.visits.withColumn("size", F.col("size") / 1000), "source", "size", F.col("status") == 500).withColumn("quality", micro(F.col("quality")))


@query("agg_4", f"SELECT count(*) AS n, count(*) FILTER (quality = 1) AS passed, {m('count(*) FILTER (quality = 1) / greatest(count(*), 1)')} AS rate FROM labels")
def _(t):
    return measure.pass_rate(t.labels, F.col("quality") == 1).withColumn("rate", micro(F.col("rate")))


@query("agg_5", f"WITH h AS (SELECT {HOST.format('source_url')} AS s, {HOST.format('target_url')} AS host, nofollow FROM links) SELECT host, {m('greatest(0, count(DISTINCT s) - 0.25 * count(*) FILTER (nofollow))')} AS authority FROM h WHERE host <> '' GROUP BY host")
def _(t):
    return measure.authority_by_hosts(t.links, "source_url", "target_url", "nofollow").withColumn("authority", micro(F.col("authority")))


@query("agg_6", f"WITH n AS (SELECT {HOST.format('source_url')} AS host, count(*) AS n FROM links GROUP BY 1) SELECT host, {m('100.0::DOUBLE * n / (SELECT max(n) FROM n)')} AS authority FROM n")
def _(t):
    return measure.authority_by_links(t.links, "source_url").withColumn("authority", micro(F.col("authority")))


@query("agg_8", f"SELECT count(*) AS links, count(DISTINCT {HOST.format('source_url')}) AS hosts, count(DISTINCT target_url) AS targets, count(*) FILTER (nofollow) AS nofollow FROM links")
def _(t):
    return measure.link_summary(t.links, "source_url", "target_url", "nofollow")


@query("agg_9", f"SELECT count(*) AS n, count(*) FILTER (ts >= {NOW} - INTERVAL 24 HOUR) AS recent FROM logs")
def _(t):
    return measure.last_day(t.logs, "ts", now(t))


@query("agg_10", "SELECT session_id, count(*) AS pages, count(*) FILTER (status = 500) AS errors FROM visits GROUP BY session_id")
def _(t):
    sessions = t.visits.select("session_id").distinct()
    return measure.session_stats(sessions, t.visits, t.visits.where("status = 500"), "session_id", "session_id")


@query("agg_11", f"SELECT count(*) AS pages, count(DISTINCT {H}) AS hosts FROM visits")
def _(t):
    return t.visits.agg(F.count("*").alias("pages"), F.count_distinct(select.host(F.col("url"))).alias("hosts"))


@query("agg_12", "SELECT count(*) AS n FROM (SELECT source_url FROM links UNION SELECT target_url FROM links) x")
def _(t):
    return measure.distinct_urls(t.links, "source_url", "target_url").agg(F.count("*").alias("n"))


@query("agg_13", f"SELECT DISTINCT {HOST.format('source_url')} AS host FROM links WHERE len(string_split({HOST.format('source_url')}, '.')) > 2")
def _(t):
    return measure.subdomains(t.links, "source_url")


@query("agg_14", "WITH last AS (SELECT 'last' AS kind, level, id AS n FROM logs WHERE level = 'error' ORDER BY ts DESC, id DESC LIMIT 10) SELECT 'count' AS kind, level, count(*) AS n FROM logs GROUP BY level UNION ALL SELECT * FROM last")
def _(t):
    counts = t.logs.groupBy("level").agg(F.count("*").alias("n")).select(F.lit("count").alias("kind"), "level", "n")
    last = select.page(t.logs.where(F.col("level") == "error"), [F.desc("ts"), F.desc("id")], 10)
    return counts.union(last.select(F.lit("last").alias("kind"), "level", F.col("id").alias("n")))


@query("agg_15", f"SELECT {STATUS} AS status, count(*) AS n FROM shards GROUP BY 1")
def _(t):
    return t.shards.groupBy(measure.health(F.col("used")).alias("status")).agg(F.count("*").alias("n"))


@query("agg_16", "SELECT n_name AS country, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    n = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("_n"))
    return t.nation.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("country"), F.coalesce("_n", F.lit(0)).alias("n"))


@query("agg_17", f"SELECT count(*) AS total, count(*) FILTER (status = 200) AS done, count(*) FILTER (status = 500) AS failed, {m('100.0::DOUBLE * count(*) FILTER (status = 200) / count(*)')} AS percent FROM visits")
def _(t):
    return measure.progress(t.visits, F.col("status") == 200, F.col("status") == 500).withColumn("percent", micro(F.col("percent")))


@query("agg_18", f"SELECT nofollow, count(*) AS links, {m('avg(authority)')} AS authority FROM links GROUP BY nofollow")
def _(t):
    return t.links.groupBy("nofollow").agg(F.count("*").alias("links"), micro(F.avg("authority")).alias("authority"))


@query("agg_19", f"""WITH r AS (SELECT conv_id, turn + 1 AS place, length(text) % 3 AS rel FROM turns), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rel DESC, place) AS best FROM r),
q AS (SELECT conv_id, sum(CASE WHEN place <= 10 THEN rel / log2(place + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN rel / log2(best + 1.0) ELSE 0 END) AS ideal, min(place) FILTER (rel > 0) AS f FROM b GROUP BY conv_id)
SELECT count(*) AS n, count(f) AS hits, {m('avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END)')} AS ndcg, {m('avg(coalesce(1.0 / f, 0))')} AS rr FROM q""")
def _(t):
    rows = t.turns.select("conv_id", (F.col("turn") + 1).alias("place"), (F.length("text") % 3).alias("rel"))
    q = measure.ndcg(rows, "conv_id", "place", "rel")
    return q.agg(F.count("*").alias("n"), measure.count_if(F.col("rr") > 0).alias("hits"), micro(F.avg("ndcg")).alias("ndcg"), micro(F.avg("rr")).alias("rr"))


@query("mth_9", f"WITH r AS (SELECT conv_id, turn + 1 AS place, length(text) % 3 AS rel FROM turns) SELECT conv_id, {m('sum(CASE WHEN place <= 10 THEN rel / log2(place + 1.0) ELSE 0 END)')} AS dcg, {m('coalesce(1.0 / min(place) FILTER (rel > 0), 0)')} AS rr FROM r GROUP BY conv_id")
def _(t):
    rows = t.turns.select("conv_id", (F.col("turn") + 1).alias("place"), (F.length("text") % 3).alias("rel"))
    return measure.ndcg(rows, "conv_id", "place", "rel").select("conv_id", micro(F.col("dcg")).alias("dcg"), micro(F.col("rr")).alias("rr"))


TITLES = "WITH r AS (SELECT id, row_number() OVER (ORDER BY overall_rank DESC, id) - 1 AS place, regexp_extract_all(lower(title), '[a-z]{3,}') AS ws FROM items QUALIFY place < 60)"


@query("agg_22", f"""{TITLES}, u AS (SELECT id, 1 / (1 + 0.4 * place) AS w, unnest(list_distinct(ws)) AS term, 1 AS size FROM r),
b AS (SELECT id, 1.5 / (1 + 0.4 * place) AS w, unnest(list_distinct(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS term, 2 AS size FROM r),
g AS (SELECT term, size, sum(w) AS score, count(*) AS titles FROM (SELECT * FROM u UNION ALL SELECT * FROM b) x GROUP BY ALL) SELECT term, titles, {m('score')} AS score FROM g WHERE size = 2 OR titles >= 2 ORDER BY g.score DESC, term LIMIT 8""")
def _(t):
    top = t.items.orderBy(F.desc("overall_rank"), "id").limit(60)  # the results of one search
    from pyspark.sql import Window

    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("overall_rank"), "id")) - 1)
    out = measure.related_terms(ranked, "id", "place", F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), F.lit(0)))
    return out.withColumn("score", micro(F.col("score")))


@query("agg_23", f"WITH k AS (SELECT session_id, size, row_number() OVER (PARTITION BY session_id ORDER BY crawled_at DESC, id DESC) AS rn FROM visits) SELECT session_id, {m('avg(size) / 1000')} AS mean, count(*) AS n FROM k WHERE rn <= 5 GROUP BY session_id")
def _(t):
    last = select.cap(t.visits, ["session_id"], [F.desc("crawled_at"), F.desc("id")], 5)
    return last.groupBy("session_id").agg(micro(measure.mean_in_order("size", ["crawled_at", "id"]) / 1000).alias("mean"), F.count("*").alias("n"))


# windows, orders, sets
@query("win_3", f"WITH k AS (SELECT id, {H} AS host, row_number() OVER (PARTITION BY {H} ORDER BY id) AS rn FROM visits) SELECT host, min(id) AS lead, count(*) - 1 AS siblings FROM k GROUP BY host")
def _(t):
    h = t.visits.select("id", select.host(F.col("url")).alias("host"))
    lead = merge.first_wins(h, ["host"], ["id"]).select("host", F.col("id").alias("lead"))
    return lead.join(h.groupBy("host").agg((F.count("*") - 1).alias("siblings")), "host")


@query("win_4", "SELECT title, min(id) AS id FROM items GROUP BY title")
def _(t):
    return merge.first_wins(t.items.select("title", "id"), ["title"], ["id"])


@query("win_9", "WITH k AS (SELECT level, id, row_number() OVER (PARTITION BY level ORDER BY id) AS rn FROM logs) SELECT level, id FROM k WHERE rn <= 5")
def _(t):
    return select.cap(t.logs, ["level"], [F.col("id")], 5).select("level", "id")


@query("win_10", "WITH k AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM logs) SELECT user_id, id FROM k WHERE rn <= 30")
def _(t):
    return select.cap(t.logs, ["user_id"], [F.desc("ts"), F.desc("id")], 30).select("user_id", "id")


@query("win_13", "SELECT id, row_number() OVER (PARTITION BY source_name ORDER BY overall_rank DESC, id) - 1 AS place FROM items")
def _(t):
    from pyspark.sql import Window

    return t.items.select("id", (F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("overall_rank"), "id")) - 1).cast("long").alias("place"))


@query("win_14", "SELECT id FROM logs ORDER BY ts DESC, id DESC LIMIT 1000")
def _(t):
    return select.page(t.logs, [F.desc("ts"), F.desc("id")], 1000).select("id")


@query("top_2", "SELECT id, category FROM items ORDER BY overall_rank DESC, id LIMIT 25")
def _(t):
    return select.page(t.items, [F.desc("overall_rank"), F.col("id")], 25).select("id", "category")


@query("top_3", f"WITH s AS (SELECT id, overall_rank, CASE WHEN contains(lower(title), 'the') THEN 2.0 ELSE 1.0 END * overall_rank AS score FROM items WHERE contains(lower(title || ' ' || content), 'the') AND contains(lower(title || ' ' || content), 'ing')) SELECT id, {m('score')} AS score FROM s ORDER BY s.score DESC, overall_rank DESC, id LIMIT 30")
def _(t):
    tokens = ["the", "ing"]
    boost = F.when(F.contains(F.lower("title"), F.lit(tokens[0])), 2.0).otherwise(1.0) * F.col("overall_rank")
    hits = t.items.where(select.holds_all([F.col("title"), F.col("content")], tokens)).withColumn("score", boost)
    return select.page(hits, [F.desc("score"), F.desc("overall_rank"), F.col("id")], 30).select("id", micro(F.col("score")).alias("score"))


@query("top_4", "SELECT url FROM visits ORDER BY url LIMIT 20 OFFSET 40")
def _(t):
    return select.page(t.visits, [F.col("url")], 20, 3).select("url")


@query("top_5", "WITH q AS (SELECT lower(level) AS query, count(*) AS n, max(ts) AS last_seen FROM logs GROUP BY 1) SELECT query, n FROM q WHERE starts_with(query, 'c') OR starts_with(query, 'p') ORDER BY n DESC, last_seen DESC LIMIT 10")
def _(t):
    popular = merge.query_counter(t.logs, "level", "ts").where(F.col("query").startswith("c") | F.col("query").startswith("p"))
    return select.page(popular, [F.desc("n"), F.desc("last_seen")], 10).select("query", "n")


@query("top_6", "SELECT id FROM seeds ORDER BY priority DESC, last_crawled ASC NULLS FIRST, id LIMIT 50")
def _(t):
    return select.page(t.seeds, [F.desc("priority"), F.asc_nulls_first("last_crawled"), F.col("id")], 50).select("id")


@query("top_7", "SELECT id FROM visits ORDER BY crawled_at DESC, id LIMIT 20")
def _(t):
    return select.page(t.visits, [F.desc("crawled_at"), F.col("id")], 20).select("id")


@query("top_8", "SELECT id FROM sources ORDER BY priority, -quality, id LIMIT 40")
def _(t):
    return select.page(t.sources, [F.col("priority"), -F.col("quality"), F.col("id")], 40).select("id")


@query("top_9", "SELECT id FROM items ORDER BY overall_rank DESC, id LIMIT 30")
def _(t):
    return select.page(t.items, [F.desc("overall_rank"), F.col("id")], 30).select("id")


@query("top_10", "SELECT id FROM items ORDER BY authority DESC, id LIMIT 10 OFFSET 20")
def _(t):
    return select.page(t.items, [F.desc("authority"), F.col("id")], 10, 3).select("id")


@query("top_11", "SELECT id, 5 + CASE WHEN contains(url, '1') THEN 3 ELSE 0 END + CASE WHEN status = 200 THEN 2 ELSE 0 END AS priority FROM visits ORDER BY priority DESC, length(url), url LIMIT 50")
def _(t):
    p = F.lit(5) + F.when(F.contains("url", F.lit("1")), 3).otherwise(0) + F.when(F.col("status") == 200, 2).otherwise(0)
    return select.page(t.visits.withColumn("priority", p), [F.desc("priority"), F.length("url"), F.col("url")], 50).select("id", "priority")


@query("top_12", f"SELECT {HOST.format('source_url')} AS host, count(*) AS n FROM links GROUP BY 1 ORDER BY n DESC, host LIMIT 5")
def _(t):
    return select.page(t.links.groupBy(select.host(F.col("source_url")).alias("host")).agg(F.count("*").alias("n")), [F.desc("n"), F.col("host")], 5)


@query("set_1", "SELECT source_url AS url FROM links UNION SELECT target_url FROM links")
def _(t):
    return measure.distinct_urls(t.links, "source_url", "target_url")


@query("set_2", "SELECT id, 1 AS tier FROM items WHERE id % 5 < 2 UNION ALL SELECT id, 2 FROM items WHERE id % 5 IN (2, 3)")
def _(t):
    return select.append_new(t.items.where("id % 5 < 2").select("id", F.lit(1).alias("tier")), t.items.where("id % 5 < 4").select("id", F.lit(2).alias("tier")), "id")


@query("set_3", "SELECT session_id AS id, name, kind, NULL::VARCHAR AS priority FROM sessions UNION ALL SELECT id, name, NULL, priority::VARCHAR FROM sources")
def _(t):
    one = t.sessions.select(F.col("session_id").alias("id"), "name", "kind")
    return one.unionByName(t.sources.select("id", "name", F.col("priority").cast("string")), allowMissingColumns=True)


@query("set_5", "WITH u AS (SELECT source_url, target_url, min(id) AS f FROM links GROUP BY ALL) SELECT source_url, md5(string_agg(target_url, ' ' ORDER BY f, target_url)) AS targets FROM u GROUP BY 1")
def _(t):
    lists = t.links.groupBy("source_url").agg(F.array_sort(F.collect_list(F.struct("id", "target_url"))).alias("ls"))
    return lists.select("source_url", F.md5(F.array_join(F.array_distinct(F.transform("ls", lambda x: x["target_url"])), " ")).alias("targets"))


@query("win_2", f"WITH r AS (SELECT page_id, {H} AS host, row_number() OVER (ORDER BY page_id) AS place FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS rn FROM r), h AS (SELECT *, place <= 10 AND rn > 2 AS held FROM k) SELECT page_id, row_number() OVER (ORDER BY held, place) AS new_place FROM h")
def _(t):
    from pyspark.sql import Window

    block = F.floor(F.col("page_id") / 1000)
    p = t.pages.select("page_id", select.host(F.col("url")).alias("host"), block.alias("block"))
    n = p.groupBy("block").agg(F.count("*").alias("n"))
    starts = n.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("start"))  # one row a thousand ids
    placed = p.join(F.broadcast(starts), "block").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("block").orderBy("page_id")))
    return select.diversify(placed, "host", "place").select("page_id", "new_place")


# keyed state, schedule, remaining
@query("dt_7", """WITH k AS (SELECT session_id, size, status, row_number() OVER (PARTITION BY session_id ORDER BY crawled_at DESC, id DESC) AS rn FROM visits), a AS (SELECT session_id, avg(CASE WHEN size > 150000 THEN 1.0 ELSE 0.6 END) AS q, avg(CASE WHEN status = 500 THEN 1.0 ELSE 0 END) AS e, count(*) FILTER (rn <= 3) AS n3, count(DISTINCT CASE WHEN rn <= 3 THEN status END) AS kinds FROM k WHERE rn <= 5 GROUP BY 1),
h AS (SELECT *, CASE WHEN q >= 0.9 THEN 24 WHEN q >= 0.7 THEN 72 WHEN q >= 0.5 THEN 168 ELSE 720 END * CASE WHEN e > 0.5 THEN 2 ELSE 1 END AS b FROM a) SELECT session_id, CASE WHEN n3 = 3 AND kinds = 1 THEN b * 1.5 WHEN n3 = 3 AND kinds = 3 THEN greatest(12, b * 0.5) ELSE b END::DOUBLE AS hours FROM h""")
def _(t):
    runs = t.visits.select("session_id", F.struct("crawled_at", "id").alias("crawled_at"), F.when(F.col("size") > 150000, 1.0).otherwise(0.6).alias("q"), F.when(F.col("status") == 500, 1.0).otherwise(0.0).alias("e"), "status")
    return measure.recrawl_hours(runs, "session_id", "crawled_at", "q", "e", "status")


@query("stm_2", "WITH v AS (SELECT id, level, lag(level) OVER (PARTITION BY user_id ORDER BY ts, id) AS old, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM logs) SELECT id, CASE WHEN rn = 1 THEN 'new' WHEN old <> level THEN 'updated' ELSE 'unchanged' END AS change FROM v")
def _(t):
    from pyspark.sql import Window

    old = F.lag("level").over(Window.partitionBy("user_id").orderBy("ts", "id"))
    return t.logs.withColumn("old", old).select("id", F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("level"), "updated").otherwise("unchanged").alias("change"))


@query("stm_4", f"SELECT id FROM logs WHERE (level = 'click' AND ts >= {NOW} - INTERVAL 168 HOUR) OR (level <> 'click' AND ts >= {NOW} - INTERVAL 720 HOUR)")
def _(t):
    at = now(t)
    return t.logs.where(F.when(F.col("level") == "click", select.within(F.col("ts"), at, 7 * 24)).otherwise(select.within(F.col("ts"), at, 30 * 24))).select("id")


@query("stm_7", f"SELECT id, CASE WHEN epoch({NOW}) - epoch(ts) <= 45 THEN 'fresh' WHEN epoch({NOW}) - epoch(ts) <= 900 THEN 'stale' ELSE 'expired' END AS state FROM logs")
def _(t):
    age = F.unix_micros(F.lit(now(t)).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return t.logs.select("id", F.when(age <= 45_000_000, "fresh").when(age <= 900_000_000, "stale").otherwise("expired").alias("state"))


@query("stm_9", f"SELECT level, count(*) AS n FROM logs WHERE ts >= {NOW} - INTERVAL 1 HOUR GROUP BY level")
def _(t):
    return t.logs.where(select.within(F.col("ts"), now(t), 1)).groupBy("level").agg(F.count("*").alias("n"))


@query("stm_12", "SELECT id, CASE WHEN last_crawled IS NULL OR last_crawled <= 5 THEN 'due' ELSE 'wait' END AS state FROM seeds")
def _(t):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("last_crawled").cast("int")), "yyyy-MM-dd")
    rows = t.seeds.withColumn("next", day)
    ready = select.due(rows, "next", "2024-01-06 00:00:00").select("id", F.lit("due").alias("state"))
    return ready.union(select.drop_known(rows, ready, "id", "id").select("id", F.lit("wait")))


@query("rem_1", "WITH v AS (SELECT session_id, max(crawled_at) AS end_time, count(*) AS pages FROM visits GROUP BY 1) SELECT s.session_id, end_time, CASE WHEN end_time IS NULL THEN 'running' ELSE 'completed' END AS status, coalesce(pages, 0) AS pages FROM sessions s LEFT JOIN v ON v.session_id = s.session_id")
def _(t):
    started = t.sessions.select("session_id", F.lit(None).cast("timestamp_ntz").alias("end_time"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("pages"))
    ended = t.visits.groupBy("session_id").agg(F.max("crawled_at").cast("timestamp_ntz").alias("end_time"), F.lit("completed").alias("status"), F.count("*").alias("pages"))
    return merge.update_columns(started, ended, ["session_id"], ["end_time", "status", "pages"])


@query("rem_2", "SELECT * FROM sessions WHERE session_id = 7")
def _(t):
    return t.sessions.where("session_id = 7")


@query("rem_3", "SELECT kind, count(*) FILTER (used < 90) AS available, count(*) AS n FROM shards GROUP BY kind")
def _(t):
    return t.shards.groupBy("kind").agg(measure.count_if(F.col("used") < 90).alias("available"), F.count("*").alias("n"))


@query("rem_4", f"SELECT id, name, {STATUS} AS status FROM shards")
def _(t):
    return t.shards.select("id", "name", measure.health(F.col("used")).alias("status"))


@query("rem_5", "SELECT url FROM (SELECT source_url AS url FROM links UNION SELECT target_url FROM links) x WHERE url LIKE 'http%'")
def _(t):
    return measure.distinct_urls(t.links, "source_url", "target_url").where(F.col("url").rlike("^https?://"))


@query("rem_9", "SELECT source_name, count(*) AS found, count(DISTINCT md5(content)) AS kept FROM items GROUP BY source_name")
def _(t):
    found = t.items.groupBy("source_name").agg(F.count("*").alias("found"))
    kept = t.items.select("source_name", F.md5("content").alias("h")).dropDuplicates(["source_name", "h"]).groupBy("source_name").agg(F.count("*").alias("kept"))
    return found.join(kept, "source_name")


@query("rem_11", "WITH q AS (SELECT name, max(quality) AS quality FROM sources GROUP BY 1) SELECT id, coalesce(q.quality, 0.7) AS quality FROM items LEFT JOIN q ON name = source_name")
def _(t):
    best = t.sources.groupBy("name").agg(F.max("quality").alias("v"))
    return select.with_default(t.items.select("id", "source_name"), best, "source_name", "name", "v", 0.7, "quality").select("id", "quality")


@query("rem_12", "SELECT CASE WHEN category = '' THEN 'unknown' ELSE category END AS category, count(*) AS n FROM items GROUP BY 1")
def _(t):
    return sinks.category_counts(t.items)


@query("rem_13", "SELECT change, count(*) AS n FROM (SELECT CASE WHEN content_hash IS NULL THEN 'new' WHEN content_hash % 2 = 0 THEN 'unchanged' ELSE 'updated' END AS change FROM visits) x GROUP BY change")
def _(t):
    old = t.visits.where("content_hash is not null").select("id", F.when(F.col("content_hash") % 2 == 0, F.col("content_hash")).otherwise(-1).alias("content_hash"))
    return select.changes(old, t.visits.select("id", "content_hash"), "id", "content_hash").groupBy("change").agg(F.count("*").alias("n"))


@query("rem_14", "SELECT DISTINCT source_url, target_url FROM links")
def _(t):
    return t.links.select("source_url", "target_url").distinct()


@query("rem_24", "SELECT id, upper(level) AS level, concat('user ', user_id, ': ', level) AS message FROM logs")
def _(t):
    return t.logs.select("id", F.upper("level").alias("level"), F.concat(F.lit("user "), F.col("user_id"), F.lit(": "), F.col("level")).alias("message"))


@query("rem_27", "SELECT target_url, max(seen) AS last_crawl, count(*) AS n FROM links GROUP BY target_url")
def _(t):
    return t.links.groupBy("target_url").agg(F.max("seen").alias("last_crawl"), F.count("*").alias("n"))


@query("rem_28", "SELECT url, max(id) AS id, arg_max(status, id) AS status FROM (SELECT concat('https://w', session_id % 50, '.example/') AS url, id, status FROM visits) x GROUP BY url")
def _(t):
    rows = t.visits.select(F.concat(F.lit("https://w"), F.col("session_id") % 50, F.lit(".example/")).alias("url"), "id", "status")
    return merge.last_wins(rows, ["url"], ["id"])


@query("rem_29", f"SELECT target_url, count(*) AS links, count(DISTINCT {HOST.format('source_url')}) AS hosts, 1 AS targets, count(*) FILTER (nofollow) AS nofollow FROM links GROUP BY target_url")
def _(t):
    return measure.link_summary(t.links.withColumn("of", F.col("target_url")), "source_url", "of", "nofollow", ["target_url"])


@query("rem_32", "SELECT id FROM sources")
def _(t):
    return select.first_or(t.seeds.where("id < 0").select("id"), t.sources.select("id"))
