"""Keyed state over event streams; each has the batch form's result when all input is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.store import scratch


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


#: Keyed state lies on the executors' disks, with a bounded part of it in memory.
STATE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, through a checkpointed query into files of the shared folder; no row goes to the driver."""
    spark = stream.sparkSession
    place = scratch(spark, "drained")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    last = []

    def whole(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/{number}")
        last[:] = [f"{place}/{number}"]

    had = spark.conf.get(STATE)
    spark.conf.set(STATE, ROCKS)
    try:
        query = (writer.format("parquet").option("path", place) if mode == "append" else writer.foreachBatch(whole)).start()
    finally:
        spark.conf.set(STATE, had)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*(last or [place]))


def query_counts(events: DataFrame) -> DataFrame:
    """Running count and last time of each normalised query."""
    norm = F.substring(F.regexp_replace(F.lower(F.trim("event_type")), r"\s+", " "), 1, 200)
    return events.withColumn("query", norm).where(F.length("query") >= 2).groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def drop_repeats(events: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """The first of each key within the watermark."""
    return _timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def hourly(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events of each type in hours of the clock, late ones within `delay`."""
    return _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


RATE_STATE = "start double, n long"


def rate_limit(requests: DataFrame, limit: int = 30, span: float = 60.0) -> DataFrame:
    """user_id, event_id, allowed: windows of `span` seconds that begin with a key's first request."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state):
        start, n = state.get if state.exists else (-1e18, 0)
        # a key's rows come in several frames, in no order
        pdf = pd.concat([f[["event_id", "at"]] for f in frames]).sort_values(["at", "event_id"])
        ok = []
        for at in pdf["at"]:
            if at - start >= span:
                start, n = float(at), 0
            n += 1
            ok.append(n <= limit)
        state.update((start, n))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "allowed": ok})

    rows = requests.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", RATE_STATE, "append", GroupStateTimeout.NoTimeout)
