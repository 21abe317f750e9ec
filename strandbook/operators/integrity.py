"""Checks over a log; every check is a table of what breaks it, or a row for each stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def density(log: DataFrame) -> DataFrame:
    """Per stream: versions run from 0 without gaps or repeats."""
    seen = log.groupBy("stream_id").agg(F.min("version").alias("low"), F.max("version").alias("high"), F.count("*").alias("n"), F.count_distinct("version").alias("kinds"))
    return seen.select("stream_id", "n", ((F.col("low") == 0) & (F.col("high") + 1 == F.col("n")) & (F.col("kinds") == F.col("n"))).alias("dense"))


def duplicate_ids(log: DataFrame) -> DataFrame:
    return log.groupBy("stream_id", "id").agg(F.count("*").alias("n")).where("n > 1")


def outcomes(attempts: DataFrame, log: DataFrame) -> DataFrame:
    """``attempts`` (attempt_id, stream_id, id, outcome) with a row for each event, ids used once -> verdict of
    each attempt: committed events are there, rejected ones are not, in-doubt ones all or none."""
    # one grouping of both tables by event instead of a distinct log and a join; an event is offered once
    asked = attempts.select("stream_id", "id", F.struct("attempt_id", "outcome").alias("asked"))
    both = asked.withColumn("stored", F.lit(0)).unionByName(log.select("stream_id", "id", F.lit(None).cast(asked.schema["asked"].dataType).alias("asked"), F.lit(1).alias("stored")))
    events = both.groupBy("stream_id", "id").agg(F.max("asked").alias("asked"), F.max("stored").alias("there")).where("asked IS NOT NULL")
    per = events.groupBy("asked.attempt_id", "asked.outcome").agg(F.count("*").alias("n"), F.sum("there").alias("there"))
    verdict = (
        F.when((F.col("outcome") == "committed") & (F.col("there") < F.col("n")), "missing")
        .when((F.col("outcome") == "rejected") & (F.col("there") > 0), "phantom")
        .when((F.col("outcome") == "indefinite") & (F.col("there") > 0) & (F.col("there") < F.col("n")), "torn")
        .otherwise("ok")
    )
    return per.select("attempt_id", "outcome", verdict.alias("verdict"))


def unknown_ids(log: DataFrame, attempts: DataFrame) -> DataFrame:
    """Events that no attempt ever offered."""
    return log.join(attempts.select("stream_id", "id").distinct(), ["stream_id", "id"], "left_anti")


def head_bounds(reads: DataFrame, commits: DataFrame) -> DataFrame:
    """``reads`` (stream_id, at, head) against ``commits`` (stream_id, done_at, last, size, outcome):
    a head is at least what was committed before, and at most what was committed in all plus the events
    of attempts in flight or in doubt.

    Reads and commits of a stream pass one window in the order of time, so no pairs are made."""
    columns = reads.columns
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    asked = reads.select("stream_id", F.col("at").cast("long").alias("time"), F.struct(*columns).alias("read"), none("last", "long"), none("size", "long"), none("outcome", "string"))
    told = commits.select("stream_id", F.col("done_at").cast("long").alias("time"), F.lit(None).cast(asked.schema["read"].dataType).alias("read"), F.col("last").cast("long").alias("last"), F.col("size").cast("long").alias("size"), "outcome")
    good = F.when(F.col("outcome") == "committed", F.col("last"))
    before = W.partitionBy("stream_id").orderBy("time").rangeBetween(W.unboundedPreceding, 0)
    met = asked.unionByName(told).withColumn("least", F.coalesce(F.max(good).over(before), F.lit(-1)))
    doubt = F.when(F.col("outcome").isin("indefinite", "inFlight"), F.col("size"))
    most = commits.groupBy("stream_id").agg((F.coalesce(F.max(F.when(F.col("outcome") == "committed", F.col("last"))), F.lit(-1)) + F.coalesce(F.sum(doubt), F.lit(0))).alias("most"))
    out = met.where("read IS NOT NULL").select("read.*", "least").join(most, "stream_id", "left").withColumn("most", F.coalesce("most", F.lit(-1)))
    return out.withColumn("honest", F.col("head").between(F.col("least"), F.col("most"))).select(*columns, "least", "most", "honest")


def storage_loss(committed: DataFrame, readable: DataFrame) -> DataFrame:
    """Committed events that can't be read."""
    return committed.join(readable.select("stream_id", "version"), ["stream_id", "version"], "left_anti")
