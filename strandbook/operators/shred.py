"""Crypto-shredding from an audit log: intents, tombstones, sweeps.

``audit``: position (version in the audit stream), type (ShredRequested, ShredCancelled,
ShredCompleted), subject, intent (position that a cancellation names), ts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _of(audit: DataFrame, kind: str) -> DataFrame:
    return audit.where(F.col("type") == kind)


def open_intents(audit: DataFrame) -> DataFrame:
    """Requests that no later cancellation names and no later completion of the subject closes.

    The latest completion of a subject tells for all its requests, so no pair of rows is made."""
    cancelled = _of(audit, "ShredCancelled").where("position > intent").select("subject", F.col("intent").alias("position")).distinct()
    closed = _of(audit, "ShredCompleted").groupBy("subject").agg(F.max("position").alias("closed"))
    left = _of(audit, "ShredRequested").join(cancelled, ["subject", "position"], "left_anti").join(closed, "subject", "left")
    return left.where("closed IS NULL OR closed <= position").select("subject", "position", "ts")


def newest_intents(opened: DataFrame) -> DataFrame:
    return opened.groupBy("subject").agg(F.max("position").alias("position"), F.max_by("ts", "position").alias("ts"))


def _fold(audit: DataFrame) -> DataFrame:
    """kind, subject, position, and status, intent, requested_at, since or outcome: a row of kind
    "outcome" for each cancellation, and one of kind "state" for each subject.

    Subjects pass in the order of their entries, so a subject of any length takes the memory of one
    state.  ``since`` is the time from which the waiting period runs: that of the request that opened
    the tombstone; a later request moves the intent alone, and only a cancellation starts it anew."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, state = None, None
        for part in batches:
            out = []
            for s, position, kind, intent, ts in zip(part["subject"], part["position"], part["type"], part["intent"].astype("Int64"), part["ts"], strict=True):
                if s != subject:
                    if state is not None:
                        out.append(("state", subject, None, *state, None))
                    subject, state = s, ("none", None, None, None)
                status, stamp, at, since = state
                if kind == "ShredRequested":
                    if status in ("none", "cancelled"):
                        state = ("pending", position, position, ts)
                    elif status == "pending":
                        state = (status, max(stamp, position), at, since)
                elif kind == "ShredCancelled":
                    outcome = "already-cancelled" if status in ("none", "cancelled") else "lost-to-commit" if status == "committing" else "superseded" if stamp != intent else "cancelled"
                    if outcome == "cancelled":
                        state = ("cancelled", stamp, at, since)
                    out.append(("outcome", s, position, None, None, None, None, outcome))
                elif kind == "ShredCompleted" and status == "pending":
                    state = ("committing", stamp, at, since)
            yield frame(out)
        if state is not None:
            yield frame([("state", subject, None, *state, None)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["kind", "subject", "position", "status", "intent", "requested_at", "since", "outcome"])
        return df.astype({"position": "Int64", "intent": "Int64", "requested_at": "Int64"}).assign(since=pd.to_datetime(df["since"]))

    given = audit.select("subject", "position", "type", F.col("intent").cast("long").alias("intent"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    ordered = given.repartition("subject").sortWithinPartitions("subject", "position")
    return ordered.mapInPandas(fold, "kind string, subject string, position long, status string, intent long, requested_at long, since timestamp_ntz, outcome string")


def tombstones(audit: DataFrame) -> DataFrame:
    """subject, status (none, pending, cancelled, committing), intent, requested_at (a position), since."""
    return _fold(audit).where("kind = 'state'").select("subject", "status", "intent", "requested_at", "since")


def cancel_outcomes(audit: DataFrame) -> DataFrame:
    """subject, position, outcome of every cancellation."""
    return _fold(audit).where("kind = 'outcome'").select("subject", "position", "outcome")


def requested(audit: DataFrame, requests: DataFrame, start: Column) -> DataFrame:
    """``audit`` with an intent for each of ``requests`` (subject, n, ts), placed from ``start`` on in the
    order of n (dense from 0).  The tombstones of the result are soft-deleted from then on."""
    new = requests.select((start + F.col("n")).cast("long").alias("position"), F.lit("ShredRequested").alias("type"), "subject", F.lit(None).cast("long").alias("intent"), "ts")
    return audit.select("position", "type", "subject", "intent", "ts").unionByName(new)


def sweep(audit: DataFrame, stones: DataFrame, now: Column, wait: str) -> DataFrame:
    """subject, position (newest open intent), outcome of every subject with an open intent:

    waiting (pending, the period is not over), due (pending, it is), committed (a sweep has passed the
    commit point; what is left is done again)."""
    newest = newest_intents(open_intents(audit)).select("subject", "position")
    over = F.col("since") + F.expr(f"INTERVAL {wait}") <= now
    outcome = F.when(F.col("status") == "committing", "committed").when(F.col("status") == "pending", F.when(over, "due").otherwise("waiting"))
    return newest.join(stones, "subject").withColumn("outcome", outcome).where("outcome IS NOT NULL").select("subject", "position", "outcome")


def commit_point(swept: DataFrame, reread: DataFrame) -> DataFrame:
    """Due subjects against the tombstones as found when they are written (``reread``: subject, status,
    etag_moved): one writer wins.  A subject whose tombstone has moved is skipped when it is cancelled,
    goes on waiting when it is pending again, and goes on to deletion when another sweep committed it."""
    met = swept.join(reread.select("subject", F.col("status").alias("now"), "etag_moved"), "subject", "left")
    moved = (F.col("outcome") == "due") & F.coalesce("etag_moved", F.lit(False))
    outcome = F.when(~moved, F.when(F.col("outcome") == "due", "committed").otherwise(F.col("outcome")))
    outcome = outcome.when(F.col("now") == "pending", "waiting").when(F.col("now") == "committing", "committed").otherwise("closed")
    return met.withColumn("outcome", outcome).drop("now", "etag_moved")


def hard_delete(generations: DataFrame, committed: DataFrame) -> DataFrame:
    """The generations that are left when the keys of ``committed`` (subject, outcome) are gone."""
    return generations.join(committed.where("outcome = 'committed'").select("subject"), "subject", "left_anti")


def completions(committed: DataFrame, start: Column) -> DataFrame:
    """position, type, subject of the audit entries of the deleted, placed from ``start`` on by subject.

    Places are counted in 1,024 ranges of subjects by hash, so no task orders them all."""
    done = committed.where("outcome = 'committed'").select("subject", F.pmod(F.xxhash64("subject"), F.lit(1024)).alias("part"))
    ahead = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = done.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy("subject")) - 1
    placed = done.withColumn("within", within).join(F.broadcast(parts), "part")
    return placed.select((start + F.col("before") + F.col("within")).cast("long").alias("position"), F.lit("ShredCompleted").alias("type"), "subject")


def report(committed: DataFrame, reconciled: DataFrame) -> DataFrame:
    """subject, outcome: hardDeleted, open (still waiting) or reconciled; other subjects have no row."""
    outcome = F.when(F.col("outcome") == "committed", "hardDeleted").when(F.col("outcome") == "waiting", "open")
    return committed.select("subject", outcome.alias("outcome")).where("outcome IS NOT NULL").unionByName(reconciled.select("subject", F.lit("reconciled").alias("outcome")))


def checkpoint(audit: DataFrame, committed: DataFrame) -> DataFrame:
    """subject, position, from_version: the open intents that the next sweep begins with, and the first
    entry that it reads.  Intents of the deleted are closed."""
    upto = audit.agg((F.max("position") + 1).alias("from_version"))
    left = open_intents(audit).join(committed.where("outcome = 'committed'").select("subject"), "subject", "left_anti")
    return left.select("subject", "position").join(F.broadcast(upto))  # one row


def resumed(checkpoint_: DataFrame, audit: DataFrame) -> DataFrame:
    """Open intents from a checkpoint and the entries since: the same as from the whole log."""
    start = checkpoint_.agg(F.max("from_version").alias("start"))
    since = audit.join(F.broadcast(start), F.col("position") >= F.coalesce("start", F.lit(0))).drop("start")
    carried = checkpoint_.select("position", F.lit("ShredRequested").alias("type"), "subject", F.lit(None).cast("long").alias("intent"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return open_intents(since.select("position", "type", "subject", "intent", "ts").unionByName(carried)).select("subject", "position")


def reconcile(stones: DataFrame, audit: DataFrame) -> DataFrame:
    """Subjects whose pending tombstone a crash left behind: its stamp is an intent that was
    cancelled, and no intent of the subject is open."""
    closed = _of(audit, "ShredCancelled").where("position > intent").select("subject", "intent").distinct()
    opened = open_intents(audit).select("subject").distinct()
    return stones.where("status = 'pending'").join(closed, ["subject", "intent"], "left_semi").join(opened, "subject", "left_anti").select("subject", "intent")


def timeline(audit: DataFrame) -> DataFrame:
    """The audit log by subject with the number of each entry."""
    return audit.withColumn("n", F.row_number().over(W.partitionBy("subject").orderBy("position")).cast("long"))
