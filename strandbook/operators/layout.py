"""Physical layouts: chunks of a mutable tail, buckets of immutable commits, compaction.

``commits`` has one row for each commit: stream_id, commit_seq (dense from 0), base_version,
commit_size, last_version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import bucket_base

COMMITS_PER_CHUNK = 20
BYTE_CAP = 256 * 1024


def commits_of(log: DataFrame, starts: Column) -> DataFrame:
    """The log's events with commit_seq and base_version; ``starts`` is true where a commit begins."""
    order = W.partitionBy("stream_id").orderBy("version")
    seq = F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1
    # a commit's first version is the last one at which a commit began: the same window, no shuffle
    base = F.last(F.when(starts, F.col("version")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return log.withColumn("commit_seq", seq).withColumn("base_version", base)


def commit_table(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_id", "commit_seq", "base_version").agg(F.count("*").alias("commit_size"), F.max("version").alias("last_version"))


def tail_chunks(commits: DataFrame, n: int | Column = COMMITS_PER_CHUNK) -> DataFrame:
    """Chunks of at most n commits; n may be a column that is the same in all commits of a stream."""
    n = F.lit(n) if isinstance(n, int) else n
    numbered = commits.withColumn("n", n.cast("long")).withColumn("chunk", F.expr("commit_seq div n"))
    return numbered.groupBy("stream_id", "chunk", "n").agg(
        F.min("base_version").alias("chunk_base"), F.count("*").alias("commits"), F.max("last_version").alias("last_version")
    ).withColumn("sealed", F.col("commits") >= F.col("n")).drop("chunk")


def roll_by_size(commits: DataFrame, size: str, n: int = COMMITS_PER_CHUNK, byte_cap: int = BYTE_CAP) -> DataFrame:
    """Adds chunk_base: a commit opens a new chunk when the chunk as read has n commits or byte_cap
    bytes.  A chunk's size depends on where it began, so this is a fold; streams pass through it
    sorted, and only the open chunk of one stream is held."""
    columns = commits.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, base, count, held = None, 0, 0, 0
        for part in batches:
            out = []
            for s, b, z in zip(part["stream_id"], part["base_version"], part[size], strict=True):
                if s != stream or count >= n or held >= byte_cap:
                    stream, base, count, held = s, b, 0, 0
                count, held = count + 1, held + z
                out.append(base)
            yield part.assign(chunk_base=pd.Series(out, index=part.index, dtype="int64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in commits.schema.fields)
    ordered = commits.repartition("stream_id").sortWithinPartitions("stream_id", "commit_seq")
    return ordered.select(*columns).mapInPandas(fold, f"{fields}, chunk_base long")


def roll_by_policy(commits: DataFrame, n: int = COMMITS_PER_CHUNK, byte_cap: int = BYTE_CAP) -> DataFrame:
    """``commits`` (stream_id, commit_seq, base_version, bytes, create_n, policy_n, create_cap, policy_cap)
    with chunk_base, n, byte_cap: the policy stamped into the chunk that holds each commit.

    A chunk's policy is chosen when it is minted: what the creating commit asks for (only in an empty
    stream), else what the resolver says for the stream just then, else that of the chunk before, else
    the store's default.  The chunk as read decides whether the next commit rolls, by the policy that
    it carries.  Streams pass sorted; the open chunk of one stream is held."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, base, count, held, policy = None, 0, 0, 0, (n, byte_cap)
        for part in batches:
            out = []
            rows = part[["stream_id", "base_version", "bytes", "create_n", "policy_n", "create_cap", "policy_cap"]]
            for s, b, z, *wanted in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
                create_n, policy_n, create_cap, policy_cap = wanted
                if s != stream:
                    stream, base, count, held = s, b, 0, 0
                    before = (n, byte_cap)
                    policy = tuple(next(int(x) for x in given if x is not None) for given in ((create_n, policy_n, before[0]), (create_cap, policy_cap, before[1])))
                elif count >= policy[0] or held >= policy[1]:
                    base, count, held = b, 0, 0
                    policy = tuple(int(x) if x is not None else old for x, old in zip((policy_n, policy_cap), policy, strict=True))
                count, held = count + 1, held + z
                out.append((base, *policy))
            chosen = pd.DataFrame(out, columns=["chunk_base", "n", "byte_cap"], dtype="int64")
            yield pd.concat([part[["stream_id", "commit_seq", "base_version"]].reset_index(drop=True), chosen], axis=1)

    light = commits.select("stream_id", "commit_seq", "base_version", "bytes", "create_n", "policy_n", "create_cap", "policy_cap")
    ordered = light.repartition("stream_id").sortWithinPartitions("stream_id", "commit_seq")
    return ordered.mapInPandas(fold, "stream_id string, commit_seq long, base_version long, chunk_base long, n long, byte_cap long")


def compaction_outcomes(tail: DataFrame, chunked: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """One compaction step of every stream: stream_id, bucket, status.

    ``tail``: commits that are still there (stream_id, base_version); ``chunked`` (stream_id, chunk_base):
    chunks that exist when the step writes; ``listed``: those that it saw before.  The bucket after the
    last listed chunk is taken.  compacted: it is sealed and its chunk is written; stood-down: another
    compactor's chunk is there; nothing-to-do: it isn't sealed.

    A commit of many events can reach over a whole bucket, in which no commit begins then: its chunk is
    written empty, so that chunks stay dense.  Such a commit stands in an earlier chunk; ``listed`` tells
    it by last_version, the last version in the chunk, if it has this column.  Any other sealed bucket
    without commits and without a chunk is corrupt."""
    reach = F.max("last_version") if "last_version" in listed.columns else F.lit(None).cast("long")
    last = listed.groupBy("stream_id").agg((F.max("chunk_base") + n).alias("bucket"), reach.alias("reach"))
    streams = tail.groupBy("stream_id").agg(F.max("base_version").alias("top")).join(last, "stream_id", "left")
    streams = streams.withColumn("bucket", F.coalesce("bucket", F.lit(0)).cast("long"))
    there = tail.select("stream_id", bucket_base(F.col("base_version"), n).alias("bucket")).distinct().withColumn("members", F.lit(True))
    done = chunked.select("stream_id", F.col("chunk_base").alias("bucket")).distinct().withColumn("chunk", F.lit(True))
    met = streams.join(there, ["stream_id", "bucket"], "left").join(done, ["stream_id", "bucket"], "left")
    lost = F.raise_error(F.concat(F.lit("sealed bucket without commits in "), F.col("stream_id"))).cast("string")
    status = F.when(F.col("top") < F.col("bucket") + n, "nothing-to-do").when(F.col("chunk"), "stood-down").when(F.col("members") | (F.col("reach") >= F.col("bucket") + n - 1), "compacted").otherwise(lost)
    return met.select("stream_id", "bucket", status.alias("status"))


def without_sources(tail: DataFrame, outcomes: DataFrame, n: int) -> DataFrame:
    """``tail`` after a step: the commits of buckets whose chunk exists go, whoever wrote it."""
    done = outcomes.where("status <> 'nothing-to-do'").select("stream_id", "bucket")
    return tail.withColumn("bucket", bucket_base(F.col("base_version"), n)).join(done, ["stream_id", "bucket"], "left_anti").drop("bucket")


def chunk_pruned(events: DataFrame, chunks: DataFrame, first: int) -> DataFrame:
    """Events from version ``first``, read from the chunk that covers it onward."""
    start = chunks.where(F.col("chunk_base") <= first).groupBy("stream_id").agg(F.max("chunk_base").alias("start"))
    return events.where(F.col("version") >= first).join(start, "stream_id", "left").where(F.coalesce("start", F.lit(0)) <= F.col("base_version"))


def sealed_buckets(commits: DataFrame, n: int) -> DataFrame:
    """Buckets of commits by base; one is sealed when its stream has a base beyond it."""
    at = commits.withColumn("bucket", bucket_base(F.col("base_version"), n))
    grouped = at.groupBy("stream_id", "bucket").agg(F.count("*").alias("commits"), F.sum("commit_size").alias("events"), F.min("base_version").alias("first_base"), F.max("base_version").alias("last_base"))
    top = grouped.groupBy("stream_id").agg(F.max("last_base").alias("top"))
    return grouped.join(top, "stream_id").withColumn("sealed", F.col("top") >= F.col("bucket") + n).drop("top")


def compaction_plan(buckets: DataFrame, chunked: DataFrame | None = None) -> DataFrame:
    """The lowest sealed bucket of each stream that has no chunk yet."""
    left = buckets.where("sealed")
    if chunked is not None:
        left = left.join(chunked.select("stream_id", F.col("chunk_base").alias("bucket")), ["stream_id", "bucket"], "left_anti")
    return left.groupBy("stream_id").agg(F.min("bucket").alias("bucket"))


def compact(events: DataFrame, buckets: DataFrame, n: int) -> DataFrame:
    """Events of all sealed buckets with their chunk_base, to be written before sources go."""
    at = events.withColumn("bucket", bucket_base(F.col("base_version"), n))
    sealed = buckets.where("sealed").select("stream_id", "bucket")
    return at.join(sealed, ["stream_id", "bucket"], "left_semi").withColumnRenamed("bucket", "chunk_base")


def compacted_read(chunked: DataFrame, tail: DataFrame, n: int, first: int = 0, chunks: DataFrame | None = None) -> DataFrame:
    """Chunks, and those commits of the tail whose bucket has no chunk; chunks are authoritative.

    ``chunks`` (stream_id, chunk_base) lists the chunks that exist, those without a readable event among
    them; without it they are the ones that ``chunked`` has events of."""
    have = (chunked if chunks is None else chunks).select("stream_id", F.col("chunk_base").alias("bucket")).distinct()
    rest = tail.withColumn("bucket", bucket_base(F.col("base_version"), n)).join(have, ["stream_id", "bucket"], "left_anti").drop("bucket")
    return chunked.drop("chunk_base").unionByName(rest).where(F.col("version") >= first)


def discontiguous(read: DataFrame) -> DataFrame:
    """Commits (stream_id, base_version, commit_size) of a read that don't begin where the one before
    ends; the first must begin at 0."""
    order = W.partitionBy("stream_id").orderBy("base_version")
    expected = F.coalesce(F.lag(F.col("base_version") + F.col("commit_size")).over(order), F.lit(0))
    return read.withColumn("expected", expected.cast("long")).where("base_version <> expected")


def contiguous(read: DataFrame) -> DataFrame:
    """``read``, which fails where a commit is missing or stands twice."""
    order = W.partitionBy("stream_id").orderBy("base_version")
    expected = F.coalesce(F.lag(F.col("base_version") + F.col("commit_size")).over(order), F.lit(0))
    broken = F.raise_error(F.concat(F.lit("discontiguous at base "), F.col("base_version").cast("string"), F.lit(" of "), F.col("stream_id"))).cast("long")
    return read.withColumn("base_version", F.when(F.col("base_version") == expected, F.col("base_version")).otherwise(broken))


def garbage(commits: DataFrame, watermark: DataFrame) -> DataFrame:
    """Commits below the watermark of their stream (stream_id, watermark)."""
    return commits.join(watermark, "stream_id").where(F.col("base_version") < F.col("watermark")).drop("watermark")


def compaction_suggested(commits: DataFrame, watermark: Column, n: int) -> DataFrame:
    return commits.withColumn("suggested", F.col("base_version") >= watermark + n)
