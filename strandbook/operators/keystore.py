"""Key generations of subjects: current keys, keyrings, what can't be delivered any more.

``generations``: subject, generation, key (a column that isn't shown).  ``tombstones``: subject,
status; a subject is soft-deleted while its tombstone is pending or committing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import generation_id

GONE = ("pending", "committing")


def soft_deleted(tombstones: DataFrame) -> DataFrame:
    return tombstones.where(F.col("status").isin(*GONE)).select("subject")


def current_keys(generations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The newest generation of every subject that isn't soft-deleted."""
    alive = generations.join(soft_deleted(tombstones), "subject", "left_anti")
    newest = alive.groupBy("subject").agg(F.max("generation").alias("generation"))
    return newest.withColumn("key_id", generation_id(F.col("generation")))


def keyrings(generations: DataFrame, tombstones: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row for each asked subject with its key ids in order; soft-deleted ones have none, and so do
    subjects without keys.

    A subject has few generations, so the array is small."""
    alive = generations.join(soft_deleted(tombstones), "subject", "left_anti")
    rings = alive.groupBy("subject").agg(F.array_sort(F.collect_list(generation_id(F.col("generation")))).alias("key_ids"))
    return subjects.select("subject").join(rings, "subject", "left").withColumn("key_ids", F.coalesce("key_ids", F.array().cast("array<string>")))


def keyring_entries(generations: DataFrame, tombstones: DataFrame, now: Column, seconds: int) -> DataFrame:
    """subject, key_id, key, expires_at of every key that may be delivered at ``now``."""
    alive = generations.join(soft_deleted(tombstones), "subject", "left_anti")
    return alive.select("subject", generation_id(F.col("generation")).alias("key_id"), "key", (now + F.make_dt_interval(secs=F.lit(seconds))).alias("expires_at"))


def fetches(requests: DataFrame, rings: DataFrame, now: Column, empty_seconds: int = 30) -> DataFrame:
    """What a client does about each of ``requests`` (subject, key_id, fetched_at, known): use its ring or
    fetch it again, and whether the key can be had then.

    ``rings``: keyring_entries as of now.  A ring is good until its first entry expires, an empty one for
    ``empty_seconds``; a key id that it lacks is asked for again."""
    first = rings.groupBy("subject").agg(F.min("expires_at").alias("expires_at"))
    met = requests.join(first, "subject", "left").join(rings.select("subject", "key_id", F.lit(True).alias("there")), ["subject", "key_id"], "left")
    empty_until = F.col("fetched_at") + F.make_dt_interval(secs=F.lit(empty_seconds))
    good = F.when(F.col("expires_at").isNull(), now < empty_until).otherwise(now < F.col("expires_at"))
    action = F.when(F.coalesce(good, F.lit(False)) & F.col("known"), "cached").otherwise("fetch")
    return met.select(*requests.columns, action.alias("action"), F.coalesce("there", F.lit(False)).alias("deliverable"))


def next_generation(generations: DataFrame, subjects: DataFrame) -> DataFrame:
    """The generation that a rotation mints: 0 for a subject without keys."""
    have = generations.groupBy("subject").agg(F.max("generation").alias("newest"))
    return subjects.select("subject").join(have, "subject", "left").select("subject", F.coalesce(F.col("newest") + 1, F.lit(0).cast("long")).alias("generation"))


def lookup_status(wanted: DataFrame, generations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``wanted`` (subject, generation, ...) with key and status: ok, erased (no key), or missing.

    A key is missing when there is no such generation and no tombstone that is pending or committing
    tells why; a cancelled tombstone explains nothing."""
    met = wanted.join(generations.select("subject", "generation", "key"), ["subject", "generation"], "left")
    met = met.join(soft_deleted(tombstones).withColumn("gone", F.lit(True)), "subject", "left")
    status = F.when(F.col("gone"), "erased").when(F.col("key").isNotNull(), "ok").otherwise("missing")
    return met.withColumn("status", status).withColumn("key", F.when(F.col("status") == "ok", F.col("key"))).drop("gone")


def lookup(wanted: DataFrame, generations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``wanted`` (subject, generation, ...) with key; null where the subject was erased.  A key that was
    never minted fails."""
    met = lookup_status(wanted, generations, tombstones)
    lost = F.raise_error(F.concat(F.lit("key was never minted: "), F.col("subject"))).cast("binary")
    return met.withColumn("key", F.when(F.col("status") == "missing", lost).otherwise(F.col("key"))).drop("status")


def mint(wanted: DataFrame, generations: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``wanted`` (subject, generation) -> subject, generation, key_id, outcome, stray, audit.

    ``before`` and ``after`` are the tombstones as read before and after the write.  outcome: minted,
    erased (a tombstone forbids it) or lost-race (the generation exists).  stray: an erased subject's key
    was written before its tombstone was seen; nothing is encrypted under it and no keyring has it.
    audit: KeyCreated or KeyRotated for what was minted."""
    gone = lambda stones, name: soft_deleted(stones).distinct().withColumn(name, F.lit(True))
    met = wanted.select("subject", "generation").join(gone(before, "was"), "subject", "left").join(gone(after, "then"), "subject", "left")
    met = met.join(generations.select("subject", "generation", F.lit(True).alias("exists")), ["subject", "generation"], "left")
    outcome = F.when(F.col("was"), "erased").when(F.col("exists"), "lost-race").when(F.col("then"), "erased").otherwise("minted")
    stray = F.col("then").isNotNull() & F.col("was").isNull() & F.col("exists").isNull()
    audit = F.when(F.col("outcome") == "minted", F.when(F.col("generation") == 0, "KeyCreated").otherwise("KeyRotated"))
    return met.select("subject", "generation", generation_id(F.col("generation")).alias("key_id"), outcome.alias("outcome"), stray.alias("stray")).withColumn("audit", audit)


def undeliverable(events: DataFrame, generations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``events`` (subject, generation, ...) whose key no keyring has."""
    alive = generations.join(soft_deleted(tombstones), "subject", "left_anti").select("subject", "generation")
    return events.join(alive, ["subject", "generation"], "left_anti")
