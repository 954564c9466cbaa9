"""Keyed writes as the state that they leave: upserts, last-wins, retention, deletion, migration, backfill.

Every function takes DataFrames and names of columns. Keys group and join with partial aggregation
before the shuffle; nothing is collected. A null key is a key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one with the greatest `order` columns (the last written)."""
    top = F.max(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rows.columns]).alias("row"))).alias("top")
    return rows.groupBy(*keys).agg(top).select("top.row.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one with the least `order` columns (the first seen)."""
    top = F.min(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rows.columns]).alias("row"))).alias("top")
    return rows.groupBy(*keys).agg(top).select("top.row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """`old` with the rows of `new` (one a key): new keys come in whole, known ones take the `update` columns (all by default)."""
    update = [c for c in old.columns if c not in keys] if update is None else update
    o, n = old.withColumn("_in_old", F.lit(True)).alias("o"), new.withColumn("_in_new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    in_new, in_old = F.col("n._in_new").isNotNull(), F.col("o._in_old").isNotNull()
    take = lambda c: F.when(in_new if c in update or c in keys else ~in_old, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[(F.when(in_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in keys else take(c)).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose key it lacks."""
    fresh = new.alias("n").join(old.alias("o"), [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def increment(rows: DataFrame, hits: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """`counter` raised by the number of rows of `hits` with the key."""
    n = hits.groupBy(*keys).agg(F.count("*").alias("_hits")).alias("h")
    joined = rows.alias("r").join(n, [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys], "left")
    return joined.select(*[(F.col(f"r.{c}") + F.coalesce(F.col("_hits"), F.lit(0))).alias(c) if c == counter else F.col(f"r.{c}") for c in rows.columns])


def update_columns(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], only_missing: bool = False) -> DataFrame:
    """`rows` with non-null values of `changes` (one a key) in `columns`; with only_missing, null and empty ones alone are filled."""
    joined = rows.alias("r").join(changes.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "left")

    def value(c):
        own, new = F.col(f"r.{c}"), F.col(f"c.{c}")
        return F.coalesce(F.nullif(own, F.lit("")) if only_missing else new, new if only_missing else own, own)

    return joined.select(*[value(c).alias(c) if c in columns else F.col(f"r.{c}") for c in rows.columns])


def outbound_links(links: DataFrame, source: str, target: str, position: str, most: int = 100) -> DataFrame:
    """The first `most` distinct http(s) links of each source, in order of position: source, target, place (from 1)."""
    seen = links.where(F.col(target).rlike("^https?://")).groupBy(source, target).agg(F.min(position).alias("_first"))
    place = F.row_number().over(Window.partitionBy(source).orderBy("_first", target))
    return seen.withColumn("place", place).where(F.col("place") <= most).select(source, target, "place")


def running_mean(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n and mean of value; rounding at each step, as a row-by-row update would, is left out."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def normal_query(text: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 1, most)


def query_counter(rows: DataFrame, text: str, time: str, least: int = 2) -> DataFrame:
    """query (lower, white space to one space, 200 characters), n and last_seen; shorter ones than `least` are left out."""
    q = rows.select(normal_query(F.col(text)).alias("query"), time)
    return q.where(F.length("query") >= least).groupBy("query").agg(F.count("*").alias("n"), F.max(time).alias("last_seen"))


def delete_older(rows: DataFrame, time: str, cutoff) -> DataFrame:
    """Rows that are not older than the cutoff; rows without a time stay."""
    return rows.where(~F.coalesce(F.col(time) < F.lit(cutoff), F.lit(False)))


def retain(rows: DataFrame, order: list[Column], keep: int, by: list[str] | None = None) -> DataFrame:
    """What a retention of `keep` rows (a group) prunes: all but the first in `order`."""
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)) if by else None
    if by:
        return rows.withColumn("_rank", rank).where(F.col("_rank") > keep).drop("_rank")
    kept = rows.orderBy(*order).limit(keep)
    return rows.join(kept, rows.columns, "left_anti")


def move_oldest(rows: DataFrame, time: str, key: str, n: int, place: str, to: str) -> DataFrame:
    """All rows, the `n` oldest of them with `place` set to `to` (ties by key)."""
    oldest = rows.orderBy(F.col(time).asc_nulls_last(), key).limit(n).select(F.col(key).alias("_moved"))
    joined = rows.join(F.broadcast(oldest), rows[key] == F.col("_moved"), "left")  # n rows at most
    return joined.withColumn(place, F.when(F.col("_moved").isNotNull(), F.lit(to)).otherwise(F.col(place))).drop("_moved")


def backfill_dates(items: DataFrame, candidates: list[DataFrame], key: str, date: str, freshness: str, rank: str, fresh_value) -> DataFrame:
    """Items without a date take the first candidate (key, date) that has one, in the order given; a date is never overwritten.

    The overall rank moves by 0.15 of the change in freshness, clamped to 0 and 1. fresh_value maps a date column to freshness.
    """
    out, found = items, F.lit(None).cast("string")
    for k, c in enumerate(candidates):
        one = c.where(F.col(date) != "").groupBy(key).agg(F.max(date).alias(f"_c{k}")).withColumnRenamed(key, f"_k{k}")
        out = out.join(one, out[key] == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        found = F.coalesce(found, F.col(f"_c{k}"))
    takes = (F.coalesce(F.col(date), F.lit("")) == "") & found.isNotNull()
    new = F.when(takes, fresh_value(found)).otherwise(F.col(freshness))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(rank) + 0.15 * (new - F.col(freshness))))
    values = {date: F.when(takes, found).otherwise(F.col(date)), freshness: new, rank: F.when(takes, moved).otherwise(F.col(rank))}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in items.columns])


def gated_upsert(items: DataFrame, incoming: DataFrame, key: str, verdict: str, gate=None) -> tuple[DataFrame, DataFrame]:
    """(items after the upsert, refused rows): a carried verdict decides, and where it is null the gate (a column of booleans)."""
    ok = F.coalesce(F.col(verdict), gate if gate is not None else F.lit(True))
    judged = incoming.withColumn("_ok", ok)
    passed = judged.where("_ok").select(*items.columns)
    return upsert(items, passed, [key]), judged.where(~F.col("_ok")).drop("_ok")


def audit(rejects: DataFrame, key: str, signals: str, order: list[str], most: int = 25) -> DataFrame:
    """The last refusal of each key with at most `most` signals."""
    return last_wins(rejects, [key], order).withColumn(signals, F.slice(F.coalesce(F.col(signals), F.array()), 1, most))
