"""Statistics of crawls, links, sessions, shards, logs and searches, as aggregates with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.select import host


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def mean_in_order(value: str, order: list[str]) -> Column:
    """Mean of a group's values, added from the last in `order` to the first, so that no plan changes its last digit; for small groups."""
    rows = F.sort_array(F.collect_list(F.struct(*order, value)), asc=False)
    values = F.filter(F.transform(rows, lambda x: x[value]), lambda x: x.isNotNull())
    return F.transform(F.array(values), lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v)))[0]


def index_stats(items: DataFrame, category: str, source: str, quality: str, top: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Total, rows by category, and the `top` sources with their mean quality."""
    by = items.groupBy(category).agg(F.count("*").alias("n"))
    sources = items.groupBy(source).agg(F.count("*").alias("n"), F.avg(quality).alias("quality")).orderBy(F.desc("n"), source).limit(top)
    return items.agg(F.count("*").alias("n")), by, sources


def registry_stats(sources: DataFrame, quality: str, priority: str, high: float = 0.95) -> DataFrame:
    return sources.agg(F.count("*").alias("n"), count_if(F.col(quality) >= high).alias("high_quality"), *[count_if(F.col(priority) == p).alias(f"priority_{p}") for p in (1, 2, 3)])


def run_stats(pages: DataFrame, source: str, quality: str, failed: Column) -> DataFrame:
    """Pages, errors and mean quality of each source."""
    return pages.groupBy(source).agg(F.count("*").alias("pages"), count_if(failed).alias("errors"), F.avg(quality).alias("quality"))


def pass_rate(df: DataFrame, passed: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), count_if(passed).alias("passed"), (count_if(passed) / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


def authority_by_hosts(links: DataFrame, source: str, target: str, nofollow: str) -> DataFrame:
    """Distinct referring hosts of each target host less a quarter of its nofollow links, 0 at least."""
    l = links.select(host(F.col(source)).alias("s"), host(F.col(target)).alias("host"), nofollow)  # noqa: E741
    score = F.count_distinct("s") - 0.25 * count_if(F.col(nofollow))
    return l.where("host <> ''").groupBy("host").agg(F.greatest(F.lit(0.0), score).alias("authority"))


def authority_by_links(links: DataFrame, source: str) -> DataFrame:
    """Links of each source host, scaled to 100 by the most."""
    n = links.groupBy(host(F.col(source)).alias("host")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("top")))).select("host", (100.0 * F.col("n") / F.col("top")).alias("authority"))


def link_summary(links: DataFrame, source: str, target: str, nofollow: str, by: list[str] | None = None) -> DataFrame:
    """Links, distinct source hosts and targets, and nofollow links, of all or by columns."""
    return links.groupBy(*(by or [])).agg(F.count("*").alias("links"), F.count_distinct(host(F.col(source))).alias("hosts"), F.count_distinct(target).alias("targets"), count_if(F.col(nofollow)).alias("nofollow"))


def distinct_urls(links: DataFrame, source: str, target: str) -> DataFrame:
    return links.select(F.col(source).alias("url")).union(links.select(target)).distinct()


def subdomains(df: DataFrame, url: str) -> DataFrame:
    h = host(F.col(url))
    return df.select(h.alias("host")).where(F.size(F.split("host", "[.]")) > 2).distinct()


def session_stats(sessions: DataFrame, pages: DataFrame, errors: DataFrame, key: str, of: str) -> DataFrame:
    """pages and errors of every session, counted before they are joined."""
    p = pages.groupBy(F.col(of).alias("_p")).agg(F.count("*").alias("pages"))
    e = errors.groupBy(F.col(of).alias("_e")).agg(F.count("*").alias("errors"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return sessions.join(p, F.col(key) == F.col("_p"), "left").join(e, F.col(key) == F.col("_e"), "left").select(*sessions.columns, zero("pages"), zero("errors"))


def last_day(df: DataFrame, time: str, now, hours: int = 24) -> DataFrame:
    recent = F.col(time) >= F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return df.agg(F.count("*").alias("n"), count_if(recent).alias("recent"))


def health(used: Column, critical: float = 90.0, warning: float = 75.0) -> Column:
    """Status by the share in use; an unknown share is critical."""
    return F.when(used.isNull() | (used >= critical), "critical").when(used >= warning, "warning").otherwise("healthy")


def rotation(shards: DataFrame, key: str, kind: str, used: str, status: str) -> DataFrame:
    """For each shard that is not healthy the emptiest healthy one of its kind: the minimum of each kind, then one join."""
    best = shards.where(F.col(status) == "healthy").groupBy(F.col(kind).alias("_kind")).agg(F.min(F.struct(F.col(used), F.col(key))).alias("_b"))
    return shards.where(F.col(status) != "healthy").join(best, F.col(kind) == F.col("_kind")).select(F.col(key).alias("from_shard"), F.col(f"_b.{key}").alias("to_shard"))


def progress(df: DataFrame, done: Column, failed: Column) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total"), count_if(done).alias("done"), count_if(failed).alias("failed"), (100.0 * count_if(done) / F.greatest(n, F.lit(1))).alias("percent"))


def recrawl_hours(runs: DataFrame, key: str, time: str, quality: str, errors: str, pages: str) -> DataFrame:
    """Hours to the next crawl of each source, from its last five runs.

    24, 72, 168 or 720 by mean quality (0.9, 0.7, 0.5); doubled where errors are over half; half, 12 at least, where the last three
    page counts all differ, 1.5 times where they are all the same.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))
    r = runs.withColumn("_r", rank).where("_r <= 5")
    a = r.groupBy(key).agg(F.avg(quality).alias("q"), F.avg(errors).alias("e"), F.count(F.when(F.col("_r") <= 3, 1)).alias("n3"), F.count_distinct(F.when(F.col("_r") <= 3, F.col(pages))).alias("kinds"))
    base = F.when(F.col("q") >= 0.9, 24.0).when(F.col("q") >= 0.7, 72.0).when(F.col("q") >= 0.5, 168.0).otherwise(720.0)
    hours = F.when(F.col("e") > 0.5, base * 2).otherwise(base)
    hours = F.when((F.col("n3") >= 3) & (F.col("kinds") == 1), hours * 1.5).when((F.col("n3") >= 3) & (F.col("kinds") == 3), F.greatest(F.lit(12.0), hours * 0.5)).otherwise(hours)
    return a.select(key, hours.alias("hours"))


def ndcg(results: DataFrame, query: str, place: str, relevance: str, k: int = 10) -> DataFrame:
    """DCG, NDCG (the ideal order of what was returned) and reciprocal rank of each query."""
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(relevance), place))
    gain = lambda p: F.sum(F.when(F.col(p) <= k, F.col(relevance) / F.log2(F.col(p) + 1.0)).otherwise(0.0))
    r = results.withColumn("_best", best).groupBy(query).agg(gain(place).alias("dcg"), gain("_best").alias("ideal"), F.min(F.when(F.col(relevance) > 0, F.col(place))).alias("_first"))
    return r.select(query, "dcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"), F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("rr"))


def related_terms(titles: DataFrame, key: str, place: str, words: str, most: int = 8) -> DataFrame:
    """Terms of ranked titles: each occurrence counts 1 / (1 + 0.4 place), two words in a row 1.5 times that; lone words from two titles on."""
    weight = 1.0 / (1.0 + 0.4 * F.col(place))
    one = titles.select(key, weight.alias("w"), F.explode(F.array_distinct(words)).alias("term"), F.lit(1).alias("size"))
    n = F.size(words)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    two = titles.select(key, (1.5 * weight).alias("w"), F.explode(F.array_distinct(pairs)).alias("term"), F.lit(2).alias("size"))
    got = one.unionByName(two).groupBy("term", "size").agg(F.sum("w").alias("score"), F.count("*").alias("titles"))
    return got.where("size = 2 or titles >= 2").orderBy(F.desc("score"), "term").limit(most).select("term", "titles", "score")
