"""Version-aligned pages of streams and their wire form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import canonical_from
from .replay import heads

PAGE_SIZE = 100


def _shape(size: int) -> list[Column]:
    end = F.col("page_from") + size
    complete = F.coalesce(F.col("head"), F.lit(-1)) >= end
    return [
        end.alias("page_to"),
        complete.alias("complete"),
        F.when(complete, end).alias("next"),
        F.when(F.col("page_from") > 0, F.col("page_from") - size).alias("prev"),
    ]


def pages(log: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """All pages of all streams with their number of events; a page is complete (and immutable) when
    the stream goes on beyond it."""
    if size < 1:
        raise ValueError("a page has at least one version")
    page_from = (F.col("version") - F.pmod("version", F.lit(size))).alias("page_from")
    # the head comes from the small table of pages: the log is shuffled once, after partial counts
    counted = log.groupBy("stream_id", page_from).agg(F.count("*").alias("n_events"), F.max("version").alias("last"))
    top = counted.groupBy("stream_id").agg(F.max("last").alias("head"))
    return counted.join(top, "stream_id").select("stream_id", "page_from", "n_events", *_shape(size))


def page_requests(log: DataFrame, requests: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """``requests`` (stream_id, requested) -> the page of each, whether it must be redirected, and the
    number of events in it.  Pages beyond the head, and of unknown streams, are empty and incomplete."""
    if size < 1:
        raise ValueError("a page has at least one version")
    asked = requests.withColumn("page_from", canonical_from(F.col("requested"), size))
    asked = asked.withColumn("redirect", ~F.col("requested").cast("double").eqNullSafe(F.col("page_from").cast("double")))
    counted = log.groupBy("stream_id", (F.col("version") - F.pmod("version", F.lit(size))).alias("page_from")).agg(F.count("*").alias("n_events"))
    out = asked.join(heads(log).withColumnRenamed("version", "head"), "stream_id", "left").join(counted, ["stream_id", "page_from"], "left")
    return out.select(*requests.columns, "page_from", "redirect", F.coalesce("n_events", F.lit(0)).alias("n_events"), *_shape(size))


def href(base: str, stream_id: Column, start: Column) -> Column:
    return F.when(start.isNotNull(), F.concat(F.lit(base), F.lit("/"), stream_id, F.lit("?from="), start.cast("string")))


def wire(pages_: DataFrame, base: str) -> DataFrame:
    """Links in place of cursors; null cursors stay null."""
    return pages_.withColumn("next", href(base, F.col("stream_id"), F.col("next"))).withColumn("prev", href(base, F.col("stream_id"), F.col("prev")))


def page_documents(log: DataFrame, size: int, base: str, event: list[str]) -> DataFrame:
    """stream_id, page_from, body: the JSON document of each page with its events in order.

    A page holds at most ``size`` events, so its array is bounded."""
    at = (F.col("version") - F.pmod("version", F.lit(size))).alias("page_from")
    bodies = log.groupBy("stream_id", at).agg(F.array_sort(F.collect_list(F.struct("version", *[c for c in event if c != "version"]))).alias("events"))
    shaped = wire(pages(log, size), base)
    return shaped.join(bodies, ["stream_id", "page_from"]).select("stream_id", "page_from", F.to_json(F.struct(F.col("stream_id").alias("streamId"), F.col("page_from").alias("from"), F.col("page_to").alias("to"), "complete", "events", "next", "prev"), {"ignoreNullFields": "false"}).alias("body"))


def head_documents(resources: DataFrame, base: str) -> DataFrame:
    """stream_id, body: the JSON document of each head resource (``replay.head_resource``)."""
    link = href(base, F.col("stream_id"), F.col("head"))
    return resources.select("stream_id", F.to_json(F.struct(F.col("stream_id").alias("streamId"), "version", link.alias("head"), "etag"), {"ignoreNullFields": "false"}).alias("body"))
