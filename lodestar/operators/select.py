"""Filters, semi-joins, caps and pages over any table: predicates are columns, lists are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without port, user and www."""
    found = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(found, r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def at_site(url: Column, site: str) -> Column:
    """The site's host or one below it."""
    h, s = host(url), site.lower().removeprefix("www.")
    return (h == s) | h.endswith("." + s)


def of_type(url: Column, extension: str) -> Column:
    return F.lower(path(url)).endswith("." + extension.lower().lstrip("."))


def between_dates(published: Column, after: str = "", before: str = "") -> Column:
    """Dates as text; undated rows fail any bound."""
    bounds = [published >= after] * bool(after) + [F.substring(published, 1, 10) <= before] * bool(before)
    return all_of([F.coalesce(published, F.lit("")) != "", *bounds]) if bounds else F.lit(True)


def holds_any(columns: list[Column], terms: list[str]) -> Column:
    """Any of the terms is part of the columns' joined text, letters in either case."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return any_of([F.contains(hay, F.lit(t.lower())) for t in terms])


def holds_all(columns: list[Column], terms: list[str]) -> Column:
    """Every term of two characters or more is part of the columns' joined text."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return all_of([F.contains(hay, F.lit(t.lower())) for t in terms if len(t) > 1])


def passes(row_url: Column, published: Column, text: list[Column], sites=(), types=(), after="", before="", excluded=()) -> Column:
    """All operators of a query at once: any of the sites, any of the types, the date range, none of the excluded terms."""
    return all_of(
        [
            any_of([at_site(row_url, s) for s in sites]) if sites else F.lit(True),
            any_of([of_type(row_url, t) for t in types]) if types else F.lit(True),
            between_dates(published, after, before),
            ~holds_any(text, list(excluded)) if excluded else F.lit(True),
        ]
    )


def on_list(h: Column, domains: list[str]) -> Column:
    """A host that is one of the domains or below one."""
    return h.isin(*domains) | any_of([h.endswith("." + d) for d in domains])


#: Hosts from which sound is taken.
AUDIO_HOSTS = ["upload.wikimedia.org", "commons.wikimedia.org"]


def audio_allowed(url: Column, hosts: list[str] = AUDIO_HOSTS) -> Column:
    """https, no user part, and a host on the list."""
    return url.startswith("https://") & ~F.regexp_extract(url, "^https://([^/?#]*)", 1).contains("@") & on_list(host(url), hosts)


def page(df: DataFrame, order: list[Column], limit: int, number: int = 1) -> DataFrame:
    """Page `number` (from 1) of `limit` rows in order."""
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def cap(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def within(time: Column, now, hours: float) -> Column:
    """Not older than so many hours before now."""
    return time >= F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(int(hours)))


def known_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def read_only(spark: SparkSession, statement: str) -> DataFrame:
    """The rows of one SELECT; anything else is refused before it runs."""
    plain = statement.strip().rstrip(";").strip()
    if not plain[:6].upper() == "SELECT" or ";" in plain:
        raise ValueError("only one SELECT statement")
    return spark.sql(plain)


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change of every new row: new, updated (another digest) or unchanged."""
    known = old.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), F.lit(True).alias("_known"))
    joined = new.join(known, F.col(key).eqNullSafe(F.col("_k")), "left")
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_d").eqNullSafe(F.col(digest)), "unchanged").otherwise("updated")
    return joined.select(key, change.alias("change"))


def keep_known(df: DataFrame, names: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose `column` is among `names`."""
    return df.join(names.select(F.col(name).alias("_n")), F.col(column) == F.col("_n"), "left_semi")


def drop_known(df: DataFrame, names: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose `column` is not among `names`; a null is none of them."""
    return df.join(names.select(F.col(name).alias("_n")), F.col(column) == F.col("_n"), "left_anti")


def due(df: DataFrame, next_time: str, now) -> DataFrame:
    """Rows without a next time, with one that is no time, or with one that is over."""
    at = F.try_to_timestamp(F.col(next_time).cast("string"))
    return df.where(at.isNull() | (F.lit(now).cast("timestamp") >= at))


def with_default(df: DataFrame, names: DataFrame, column: str, key: str, value: str, default, out: str) -> DataFrame:
    """`out`: the value that a small table of at most a few thousand rows gives for `column`, else the default."""
    small = names.select(F.col(key).alias("_k"), F.col(value).alias("_v")).dropDuplicates(["_k"])
    return df.join(small, F.col(column) == F.col("_k"), "left").withColumn(out, F.coalesce(F.col("_v"), F.lit(default))).drop("_k", "_v")


def append_new(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """`first`, then the rows of `second` with another key; columns that one side lacks are null."""
    return first.unionByName(drop_known(second, first, key, key), allowMissingColumns=True)


def first_or(first: DataFrame, second: DataFrame) -> DataFrame:
    """`first` unless it is empty, then `second`."""
    some = first.limit(1).select(F.lit(True).alias("_some"))
    return first.unionByName(second.join(F.broadcast(some), F.lit(True), "left_anti"), allowMissingColumns=True)


def diversify(df: DataFrame, by: str, place: str, first: int = 10, each: int = 2) -> DataFrame:
    """New places: rows beyond `each` of a group among the first `first` go to the end in their order. `place` counts from 1 without gaps."""
    head = df.where(F.col(place) <= first).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(place)))
    held = head.where(F.col("_n") > each).select(F.col(place).alias("_held"))  # at most `first` rows
    every = held.agg(F.coalesce(F.array_sort(F.collect_list("_held")), F.array().cast("array<long>")).alias("_h"))
    total = df.agg(F.count("*").alias("_total"))
    at = F.array_position(F.col("_h"), F.col(place)).cast("long")
    before = F.size(F.filter("_h", lambda h: h < F.col(place)))
    moved = F.when(at > 0, F.col("_total") - F.size("_h") + at).otherwise(F.col(place) - before)
    return df.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(total)).withColumn("new_place", moved.cast("long")).drop("_h", "_total")
