"""Admission of append attempts as a stream: each stream's head is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream_id string, arrival long, attempt_id long, ok boolean, base long"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # rows of a key may come in several frames and in any order; micro-batches follow each other
    rows = pd.concat([p for p in parts if len(p)]).sort_values(["arrival", "attempt_id"])
    head = state.get[0] if state.exists else -1
    ok, base = [], []
    for kind, want, n in zip(rows["expected_kind"], rows["expected_version"], rows["n_events"], strict=True):
        good = bool(kind == "any" or (kind == "noStream" and head < 0) or (kind == "version" and head >= 0 and head == want))
        ok.append(good)
        base.append(head + 1 if good else None)
        head += int(n) if good else 0
    state.update((head,))
    yield pd.DataFrame({"stream_id": rows["stream_id"], "arrival": rows["arrival"], "attempt_id": rows["attempt_id"], "ok": ok, "base": pd.array(base, dtype="Int64")})


def admit_stream(attempts: DataFrame) -> DataFrame:
    """The streaming twin of ``admit``: decisions for a streaming ``attempts``."""
    return attempts.groupBy("stream_id").applyInPandasWithState(_step, OUT, "head long", "append", GroupStateTimeout.NoTimeout)


def head_feed(events: DataFrame) -> DataFrame:
    """Heads of a streaming log, for update mode."""
    from pyspark.sql import functions as F

    return events.groupBy("stream_id").agg(F.max("version").alias("version"))
