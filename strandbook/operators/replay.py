"""Reading streams: ordered replay, the latest events, heads.

``log`` is a table of events (stream_id, version, ...).  Filters on version and stream reach the
Parquet scan, so a replay reads the row groups it needs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import canonical_from


def replay(log: DataFrame, first: int | Column = 0, end: int | Column | None = None, streams: DataFrame | None = None) -> DataFrame:
    """Events from version ``first`` up to but without ``end``; an unknown stream gives no rows."""
    out = log.where(F.col("version") >= first)
    if end is not None:
        out = out.where(F.col("version") < end)
    return out.join(streams.select("stream_id"), "stream_id", "left_semi") if streams is not None else out


def in_order(log: DataFrame) -> DataFrame:
    """Each stream in one partition and in version order; streams need no order among them."""
    return log.repartition("stream_id").sortWithinPartitions("stream_id", "version")


def latest(log: DataFrame, k: int) -> DataFrame:
    """The last k events of each stream.

    Versions are dense, so they are those above head - k: a grouping and a join on light rows, with
    no sort of whole streams."""
    tops = log.groupBy("stream_id").agg(F.max("version").alias("head"))
    return log.join(tops, "stream_id").where(F.col("version") > F.col("head") - k)


def heads(log: DataFrame) -> DataFrame:
    return log.groupBy("stream_id").agg(F.max("version").alias("version"))


def head_resource(log: DataFrame, streams: DataFrame, page_size: int) -> DataFrame:
    """One row for each requested stream: version (null if there is none), cursor and etag."""
    found = streams.select("stream_id").join(heads(log), "stream_id", "left")
    return found.select(
        "stream_id",
        "version",
        canonical_from(F.coalesce("version", F.lit(0)), page_size).alias("head"),
        F.when(F.col("version").isNull(), F.lit('"empty"')).otherwise(F.concat(F.lit('"v'), F.col("version").cast("string"), F.lit('"'))).alias("etag"),
    )


def poll_status(resources: DataFrame, etag: Column) -> DataFrame:
    """304 where the client's etag is the present one, else 200."""
    return resources.withColumn("status", F.when(F.col("etag").eqNullSafe(etag), 304).otherwise(200))


def since(log: DataFrame, moment: Column, first: int = 0, ts: str = "ts") -> DataFrame:
    """Events from version ``first`` on with a time of ``moment`` or later.

    Streams are read by version and filtered by time, as times need not rise with versions: the result
    may have gaps."""
    return replay(log, first).where(F.col(ts) >= moment)


def time_regressions(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Events with an earlier time than the event before: time is data here, no coordinate."""
    before = F.lag(ts).over(W.partitionBy("stream_id").orderBy("version"))
    return log.withColumn("before", before).where(F.col("before") > F.col(ts))
