"""Tables written and read back: JSON lines, Parquet, partitions by category, backups, snapshots, swaps.

Paths are URIs of a store that driver and executors share. A write goes to a new folder; `swap` makes it the
current one by a pointer row, so a reader sees the old table or the new one and nothing between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = {"id": None, "url": None, "title": "", "content": "", "language": "en", "source_name": "", "category": "unknown", "quality": 0.0, "authority": 0.0, "freshness": 0.0, "published": "", "overall_rank": 0.0}
BACKUP = [*ARCHIVE]


def write_json_lines(df: DataFrame, path: str, gzip: bool = False) -> DataFrame:
    """`df` as JSON lines in place of what is there, read back by its schema; empty columns come back as nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip" if gzip else "none").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """`df` as Snappy Parquet in place of what is there, a folder for each value of `by`, read back."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def archive_rows(items: DataFrame, columns: dict = ARCHIVE) -> DataFrame:
    """The archive's columns, nulls as the archive's defaults; columns that `items` lacks are all default."""
    value = lambda c, d: F.col(c) if c in items.columns and d is None else F.coalesce(F.col(c), F.lit(d)) if c in items.columns else F.lit(d)
    return items.select(*[value(c, d).alias(c) for c, d in columns.items()])


def category_counts(items: DataFrame, category: str = "category") -> DataFrame:
    """Rows of each category's folder; a missing or empty category is `unknown`."""
    name = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("unknown"))
    return items.groupBy(name.alias("category")).agg(F.count("*").alias("n"))


def backup(items: DataFrame, path: str) -> DataFrame:
    """The backup's columns as gzipped JSON lines."""
    return write_json_lines(items.select(*[c for c in BACKUP if c in items.columns]), path, gzip=True)


def restore(spark: SparkSession, path: str, items: DataFrame, verdict, key: str = "url") -> DataFrame:
    """`items` after an upsert of the backup's rows that pass the gate (`verdict`, a column)."""
    from lodestar.operators.merge import upsert

    rows = spark.read.schema(items.schema).json(path)
    return upsert(items, rows.where(F.coalesce(verdict, F.lit(False))), [key])


def snapshot(df: DataFrame, root: str, version: int) -> DataFrame:
    """A version of the table in a folder of its own; older versions stay as they are."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swap(df: DataFrame, root: str) -> str:
    """A new version written beside the old one and made current by one small write; returns its path."""
    path = f"{root}/data-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("append").parquet(f"{root}/current")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table that the last swap made current."""
    last = spark.read.parquet(f"{root}/current").withColumn("at", F.col("_metadata.file_modification_time")).orderBy(F.desc("at")).limit(1).first()
    return spark.read.parquet(last["path"])
