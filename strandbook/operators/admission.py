"""Deciding which append attempts commit, under optimistic concurrency.

``attempts``: stream_id, arrival (order within the stream), attempt_id, expected_kind ('any',
'noStream' or 'version'), expected_version, n_events.  Whether an attempt commits depends on all
before it, so this is a fold over each stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import valid_expected

MOST_EVENTS = 20


def validated(attempts: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """Adds ``invalid``: why an attempt is refused before any stream is looked at, or null."""
    return attempts.withColumn(
        "invalid",
        F.when(F.col("n_events") < 1, "no events")
        .when(F.col("n_events") > most, "too many events")
        .when(~valid_expected(F.col("expected_kind"), F.col("expected_version")), "expected version"),
    )


def admit(attempts: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """stream_id, arrival, attempt_id, ok, base: decisions in order of arrival.

    ``heads`` (stream_id, version) are the streams' present heads.  Streams pass sorted with one head in
    memory, so a stream of any length is possible."""
    given = attempts.select("stream_id", "arrival", "attempt_id", "expected_kind", "expected_version", "n_events")
    given = given.join(heads.select("stream_id", F.col("version").alias("head0")), "stream_id", "left") if heads is not None else given.withColumn("head0", F.lit(None).cast("long"))
    given = given.withColumn("head0", F.coalesce("head0", F.lit(-1).cast("long")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, head = None, -1
        for part in batches:
            ok, base = [], []
            for s, kind, want, n, head0 in zip(part["stream_id"], part["expected_kind"], part["expected_version"], part["n_events"], part["head0"], strict=True):
                if s != stream:
                    stream, head = s, head0
                good = kind == "any" or (kind == "noStream" and head < 0) or (kind == "version" and head >= 0 and head == want)
                ok.append(good)
                base.append(head + 1 if good else None)
                head += n if good else 0
            yield pd.DataFrame({"stream_id": part["stream_id"], "arrival": part["arrival"], "attempt_id": part["attempt_id"], "ok": ok, "base": pd.array(base, dtype="Int64")})

    ordered = given.repartition("stream_id").sortWithinPartitions("stream_id", "arrival", "attempt_id")
    return ordered.mapInPandas(fold, "stream_id string, arrival long, attempt_id long, ok boolean, base long")


def committed_events(decisions: DataFrame, payloads: DataFrame, committed_at: Column) -> DataFrame:
    """Events of committed attempts: ``payloads`` (stream_id, attempt_id, pos, id, type, data, ts).

    version = base + pos; a missing id is minted, a missing time is the commit's."""
    good = decisions.where("ok").select("stream_id", "attempt_id", "base")
    out = payloads.join(good, ["stream_id", "attempt_id"])
    return out.withColumns({"version": F.col("base") + F.col("pos"), "id": F.coalesce("id", F.expr("uuid()")), "ts": F.coalesce("ts", committed_at)})


def without_known(attempts: DataFrame, log: DataFrame) -> DataFrame:
    """Attempts whose commit_id isn't in the log: a lost answer doesn't commit twice."""
    return attempts.join(log.select("commit_id").distinct(), "commit_id", "left_anti")


def idempotent_retry(retries: DataFrame, log: DataFrame) -> DataFrame:
    """``retries`` (attempt_id, stream_id, base, pos, id) -> attempt_id, already_committed: every id
    stands in the log at exactly base + pos."""
    have = log.select("stream_id", F.col("version").alias("at"), F.col("id").alias("stored"))
    met = retries.withColumn("at", F.col("base") + F.col("pos")).join(have, ["stream_id", "at"], "left")
    return met.groupBy("attempt_id").agg(F.bool_and(F.coalesce(F.col("id") == F.col("stored"), F.lit(False))).alias("already_committed"))


def idempotent_append(attempts: DataFrame, events: DataFrame, log: DataFrame) -> DataFrame:
    """``attempts`` (attempt_id, stream_id, arrival, expected_kind, expected_version) with ``events``
    (attempt_id, pos, id) -> attempt_id, outcome, base, next_expected.

    outcome: refused (no events, an event without id, or ``any``, whose window isn't fixed), appended,
    alreadyCommitted (the ids stand in the log at exactly the window of the expected version), or
    conflict.  Refused attempts decide nothing for the others."""
    per = events.groupBy("attempt_id").agg(F.count("*").alias("n_events"), F.bool_or(F.coalesce(F.col("id"), F.lit("")) == "").alias("unnamed"))
    given = attempts.join(per, "attempt_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    fixed = valid_expected(F.col("expected_kind"), F.col("expected_version")) & (F.col("expected_kind") != "any")
    given = given.withColumn("refused", (F.col("n_events") < 1) | F.coalesce("unnamed", F.lit(False)) | ~fixed)
    heads = log.groupBy("stream_id").agg(F.max("version").alias("version"))
    decided = admit(given.where("NOT refused"), heads).select("attempt_id", "ok", F.col("base").alias("placed"))
    window = F.when(F.col("expected_kind") == "noStream", F.lit(0)).otherwise(F.col("expected_version") + 1)
    met = given.join(decided, "attempt_id", "left").withColumn("window", window)
    lost = met.where("NOT ok").select("attempt_id", "stream_id", F.col("window").alias("base"))
    ours = idempotent_retry(events.join(lost, "attempt_id").select("attempt_id", "stream_id", "base", "pos", "id"), log)
    met = met.join(ours, "attempt_id", "left")
    outcome = F.when(F.col("refused"), "refused").when(F.col("ok"), "appended").when(F.col("already_committed"), "alreadyCommitted").otherwise("conflict")
    base = F.when(F.col("ok"), F.col("placed")).when(F.col("already_committed"), F.col("window"))
    return met.select("attempt_id", outcome.alias("outcome"), base.cast("long").alias("base"), (base + F.col("n_events") - 1).cast("long").alias("next_expected"))


def forward_scan_retry(retries: DataFrame, log: DataFrame) -> DataFrame:
    """``retries`` (attempt_id, stream_id, client_version, id): committed if every id stands anywhere
    above the client's version; for events whose order doesn't matter."""
    have = log.select("stream_id", "id", "version")
    met = retries.join(have, ["stream_id", "id"], "left")
    seen = F.when(F.col("version") > F.col("client_version"), F.col("id"))
    return met.groupBy("attempt_id").agg((F.count_distinct(seen) == F.count_distinct("id")).alias("already_committed"))
