"""Queries made of DataFrame code: graph rounds, parsers and streams, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import rowwise
from lodestar.operators import gate, graph, retrieval
from lodestar.operators.dialect import Check, Spark, corpus, micro, one_row_an_item
from lodestar.session import TABLES, table
from lodestar.sources import html, records
from lodestar.streaming import state

#: Rounds, tolerance and rounds between two looks at it, as graph.pagerank has them.
ROUNDS, TOLERANCE, LOOK = 30, 1e-9, 5
FLAGSHIP = ["of", "the"]


def _views(spark, sf_dir):
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)


def _edges(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(f"WITH {retrieval.edge_list()} SELECT src, dst FROM edges")


def _micro(c):
    return F.floor(c * 1_000_000 + 0.5).cast("long")


def _items(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(f"WITH {corpus(Spark())} SELECT id, title, content, source_name, url FROM corpus")


def flagship(spark, sf_dir):
    """Keyword search: postings, BM25, blend with quality, the 20 best."""
    _views(spark, sf_dir)
    return spark.sql(retrieval.keyword_search(Spark(), FLAGSHIP))


def gr_2(spark, sf_dir):
    return graph.pagerank(_edges(spark, sf_dir)).select("node", _micro(F.col("rank")).alias("rank"))


def _rank_sql() -> str:
    """All rounds; once a look finds a change below the tolerance, ranks stay."""
    steps, stop = [], ""
    for k in range(1, ROUNDS + 1):
        p = f"r{k - 1}"
        new = f"0.15 / c.n + 0.85 * coalesce((SELECT sum(rank) FROM {p} WHERE degree IS NULL), 0) / c.n + 0.85 * coalesce(s.sent, 0)"
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT n.node, n.degree, {f'CASE WHEN {stop} THEN n.rank ELSE {new} END' if stop else new} AS rank "
            f"FROM {p} n CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank / degree) AS sent FROM edges JOIN {p} ON src = node GROUP BY dst) s ON s.dst = n.node)"
        )
        if k % LOOK == 0:
            steps.append(f"m{k} AS MATERIALIZED (SELECT sum(abs(a.rank - b.rank)) AS moved FROM r{k} a JOIN {p} b ON a.node = b.node)")
            stop = f"(SELECT moved FROM m{k}) < {TOLERANCE}"
    return f"""WITH {retrieval.edge_list().replace(' AS (', ' AS MATERIALIZED (')}, o AS (SELECT src, count(*) AS degree FROM edges GROUP BY src), nodes AS (SELECT node, degree FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) LEFT JOIN o ON src = node),
c AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT node, degree, 1 / n AS rank FROM nodes, c), {', '.join(steps)}
SELECT node, {micro('rank')} AS rank FROM r{ROUNDS}"""


def gr_3(spark, sf_dir):
    ranks = graph.pagerank(_edges(spark, sf_dir))
    top = ranks.agg(F.max("rank")).first()[0]
    return ranks.select("node", _micro(F.col("rank") / top).alias("share"))


def gr_4(spark, sf_dir):
    ranks = graph.pagerank(_edges(spark, sf_dir))
    items = _items(spark, sf_dir).select(F.col("id").alias("node"), F.lit(0.5).alias("authority"))
    return graph.blend_authority(items, ranks).select("node", _micro(F.col("authority")).alias("authority"))


def gr_5(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.reach(edges, spark.createDataFrame([(3,), (5,)], "node long"), 2)


def ir_14(spark, sf_dir):
    """The verdict of all layers for every item."""
    return gate.verdicts(_items(spark, sf_dir)).select("id", "verdict.*")


def ir_15(spark, sf_dir):
    """Every item with its verdict carried."""
    return gate.screen(_items(spark, sf_dir)).drop("content")


def del_2(spark, sf_dir):
    """The audit rows of a purge of all items."""
    return gate.purge(_items(spark, sf_dir))[1]


def mth_3(spark, sf_dir):
    return _items(spark, sf_dir).select("id", rowwise.compression(rowwise.strip(F.col("content"))).alias("ratio"))


def ir_18(spark, sf_dir):
    """Greedy first-seen deduplication over near pairs; of equal fingerprints only the first item can stay."""
    _views(spark, sf_dir)
    if one_row_an_item(spark):
        retrieval.view_links(spark)
        near = spark.sql("SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM links JOIN first a ON a.h = x JOIN first b ON b.h = y")
        return graph.first_seen(spark.table("first").select("id"), near)
    near = spark.sql(f"WITH {retrieval.near(Spark())} SELECT a, b FROM near")
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return graph.first_seen(ids, near)


def ir_19(spark, sf_dir):
    p = html.pages(table(spark, sf_dir, "pages"), fields=("title", "language", "word_count", "content_hash", "links", "media"))
    return p.select("page_id", "page.title", "page.language", "page.word_count", "page.content_hash", F.size("page.links").cast("long").alias("links"), F.size("page.media").cast("long").alias("media"))


def ir_23(spark, sf_dir):
    return html.backlinks(table(spark, sf_dir, "pages"))


def src_6(spark, sf_dir):
    line = F.concat(F.col("url"), F.lit(" 2024 "), F.to_json(F.struct("url", F.lit("TEXT/HTML").alias("mime"), F.lit("200").alias("status"), F.when(F.col("page_id") % 5 > 0, F.lit("f.gz")).alias("filename"), F.col("page_id").cast("string").alias("offset"), F.lit("10").alias("length"))))
    return records.cdx(table(spark, sf_dir, "pages").select(line.alias("value"))).select("url", "mime", "offset", "length")


def src_11(spark, sf_dir):
    line = F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("A"), F.col("o_orderpriority"))
    return records.index_lines(table(spark, sf_dir, "orders").select(line.alias("value")))


def src_29(spark, sf_dir):
    line = F.concat_ws(" - ", F.col("ts").cast("string"), F.lit("app"), F.col("event_type"), F.lit("m"), F.concat(F.lit("a - b "), F.col("event_id").cast("string")))
    return records.log_lines(table(spark, sf_dir, "events").select(line.alias("value"))).groupBy("level").agg(F.count("*").alias("n"), F.count(F.when(F.col("message").startswith("a - b"), 1)).alias("whole"))


def stm_1(spark, sf_dir):
    return state.drain(state.query_counts(state.events_stream(spark, sf_dir)), "complete")


def stm_3(spark, sf_dir):
    rows = state.drop_repeats(state.events_stream(spark, sf_dir), ["event_id"], "3650 days")
    return state.drain(rows.select("event_id", "event_type"), "append")


def stm_5(spark, sf_dir):
    return state.drain(state.rate_limit(state.events_stream(spark, sf_dir)), "append")


QUERIES = {f.__name__: f for f in (del_2, gr_2, gr_3, gr_4, gr_5, ir_14, ir_15, ir_18, ir_19, ir_23, mth_3, src_6, src_11, src_29, stm_1, stm_3, stm_5)} | {"flagship": flagship}


def oracle() -> dict[str, str]:
    d = Check()
    rank = _rank_sql()
    head, tail = rank.rsplit("SELECT node", 1)
    return {
        "flagship": retrieval.keyword_search(d, FLAGSHIP),
        "gr_2": rank,
        "gr_3": head + f"SELECT node, {micro('rank / (SELECT max(rank) FROM r' + str(ROUNDS) + ')')} AS share FROM r{ROUNDS}",
        "gr_4": head + f"SELECT i.node, {micro('CASE WHEN rank IS NULL THEN 0.5 ELSE 0.25 + 0.5 * rank / (SELECT max(rank) FROM r' + str(ROUNDS) + ') END')} AS authority FROM (SELECT doc_id AS node FROM documents) i LEFT JOIN r{ROUNDS} r ON r.node = i.node",
        "gr_5": f"WITH {retrieval.edge_list()}, a AS (SELECT unnest([3, 5])::BIGINT AS node, 0 AS depth), b AS (SELECT DISTINCT dst AS node, 1 AS depth FROM edges JOIN a ON src = node WHERE dst NOT IN (SELECT node FROM a)), c AS (SELECT DISTINCT dst AS node, 2 AS depth FROM edges JOIN b ON src = node WHERE dst NOT IN (SELECT node FROM a UNION SELECT node FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c",
        "src_6": "SELECT url, 'text/html' AS mime, page_id AS \"offset\", 10::BIGINT AS length FROM pages WHERE page_id % 5 > 0",
        "src_11": "SELECT o_orderkey AS \"offset\", o_custkey AS page_id, 'A:' || o_orderpriority AS title FROM orders",
        "src_29": "SELECT event_type AS level, count(*) AS n, count(*) AS whole FROM events GROUP BY event_type",
        "stm_1": "SELECT lower(trim(event_type)) AS query, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1",
        "stm_3": "SELECT DISTINCT event_id, event_type FROM events",
    }
