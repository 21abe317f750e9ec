"""Client transforms: upcasters and folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crypto import Subject, decrypt_fields, decrypt_payloads, is_object


def upcast(log: DataFrame, upcasters: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The upcasters one after the other, each from rows to rows; Catalyst makes them one projection."""
    return reduce(lambda d, f: d.transform(f), upcasters, log)


def fold_by_aggregates(log: DataFrame, first: int = 0, **states: Column) -> DataFrame:
    """Folds that are sums, counts, extremes: partial aggregation, no order needed."""
    return log.where(F.col("version") >= first).groupBy("stream_id").agg(F.max("version").alias("version"), *[c.alias(k) for k, c in states.items()])


def fold_in_order(log: DataFrame, value: Column, init: Column, evolve: Callable[[Column, Column], Column], first: int = 0, streams: DataFrame | None = None) -> DataFrame:
    """stream_id, version, state: a left fold in version order; ``value`` is what ``evolve`` needs of
    an event.  Streams of ``streams`` with no event from ``first`` on give (init, first - 1).

    The array of a stream's values is held, so ``value`` should be narrow and streams bounded;
    ``fold_sorted`` takes streams of any length."""
    folded = log.where(F.col("version") >= first).groupBy("stream_id").agg(F.max("version").alias("version"), F.array_sort(F.collect_list(F.struct("version", value.alias("value")))).alias("items"))
    folded = folded.select("stream_id", "version", F.aggregate("items", init, lambda s, x: evolve(s, x["value"])).alias("state"))
    if streams is None:
        return folded
    met = streams.select("stream_id").join(folded, "stream_id", "left")
    none = F.col("version").isNull()
    return met.select("stream_id", F.coalesce("version", F.lit(first - 1).cast("long")).alias("version"), F.when(none, init).otherwise(F.col("state")).alias("state"))


def fold_sorted(log: DataFrame, value: Column, init: Any, evolve: Callable[[Any, Any], Any], kind: str, first: int = 0) -> DataFrame:
    """The same with ``evolve`` in Python: streams pass sorted, and one state is held, so a stream of any
    length is possible.  ``kind``: the SQL type of the state."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, version, state = None, None, init
        for part in batches:
            done = []
            for s, v, x in zip(part["stream_id"], part["version"], part["value"], strict=True):
                if s != stream:
                    if stream is not None:
                        done.append((stream, version, state))
                    stream, state = s, init
                version, state = v, evolve(state, x)
            yield pd.DataFrame(done, columns=["stream_id", "version", "state"])
        if stream is not None:
            yield pd.DataFrame([(stream, version, state)], columns=["stream_id", "version", "state"])

    given = log.where(F.col("version") >= first).select("stream_id", "version", value.alias("value"))
    ordered = given.repartition("stream_id").sortWithinPartitions("stream_id", "version")
    return ordered.mapInPandas(fold, f"stream_id string, version long, state {kind}")


def client_read(log: DataFrame, keyring: DataFrame, field_keys: DataFrame | None = None, subject: Subject | None = None, upcasters: list[Callable[[DataFrame], DataFrame]] | None = None, first: int = 0) -> DataFrame:
    """Events from ``first`` on, decrypted by the shape of their data and upcast.

    Without key_id data is plain.  A payload that is one JSON string is a whole ciphertext, opened with
    the stream's ``keyring`` (stream_id, key_id, key), and a key that isn't there fails.  An object's
    envelopes are opened with ``field_keys`` (``decrypt_fields``); without them they stay as they are."""
    events = log.where(F.col("version") >= first)
    # what begins with a quotation mark is no object, so ciphertexts are not parsed to tell
    whole = F.col("key_id").isNotNull() & F.startswith("data", F.lit('"'))
    by_field = F.col("key_id").isNotNull() & is_object(F.col("data"))
    shape = F.when(whole, "whole").when(by_field, "fields").otherwise("plain")
    events = events.withColumn("shape", shape)
    parts = [events.where("shape = 'plain'").drop("shape")]
    text = F.get_json_object(F.concat(F.lit('{"d":'), F.col("data"), F.lit("}")), "$.d")
    opened = decrypt_payloads(events.where("shape = 'whole'").drop("shape").withColumn("data", text), keyring)
    gone = F.raise_error(F.concat(F.lit("key is not deliverable for stream "), F.col("stream_id"))).cast("string")
    parts.append(opened.withColumn("data", F.when(F.col("status") == "shredded", gone).otherwise(F.col("data"))).drop("status"))
    marked = events.where("shape = 'fields'").drop("shape")
    parts.append(decrypt_fields(marked, field_keys, subject) if field_keys is not None and subject is not None else marked)
    return upcast(reduce(lambda a, b: a.unionByName(b), parts), upcasters or [])
