"""Commit and chunk documents (one JSON document per file), and the settings check of a key bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import commit_path

#: fixed values: field names of stored documents; data and meta stay verbatim JSON text
EVENT = "id string, type string, version bigint, data string, keyId string, meta string"
COMMIT = "commitId string, streamId string, baseVersion bigint, events array<struct<id:string,type:string,version:bigint,data:string,keyId:string,meta:string>>, committedAt string"
CHUNK = "streamId string, chunkBase bigint, n int, byteCap bigint, commits array<struct<commitId:string,streamId:string,baseVersion:bigint,events:array<struct<id:string,type:string,version:bigint,data:string,keyId:string,meta:string>>,committedAt:string>>, lastCommitKey string"


def _events(commits: DataFrame) -> DataFrame:
    each = commits.select(F.col("streamId").alias("stream_id"), F.col("commitId").alias("commit_id"), F.col("baseVersion").alias("base_version"), F.size("events").alias("commit_size"), F.col("committedAt").alias("committed_at"), F.explode("events").alias("e"))
    return each.select("stream_id", F.col("e.version").alias("version"), F.col("e.id").alias("id"), F.col("e.type").alias("type"), F.col("e.data").alias("data"), F.col("e.keyId").alias("key_id"), F.col("e.meta").alias("meta"), "commit_id", "base_version", "commit_size", "committed_at")


def _read(spark: SparkSession, schema: str, path: str, whole_files: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", whole_files).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)


def read_commits(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Events of commit documents, one in each file, or one in each line."""
    return _events(_read(spark, COMMIT, path, whole_files))


def read_chunks(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Events of chunk documents, one in each file, or one in each line."""
    chunks = _read(spark, CHUNK, path, whole_files)
    return _events(chunks.select(F.explode("commits").alias("c")).select("c.*"))


def commit_documents(log: DataFrame) -> DataFrame:
    """stream_id, base_version, body: the JSON document of each commit (a commit has few events)."""
    event = F.struct("version", "id", "type", "data")
    grouped = log.groupBy("stream_id", "base_version").agg(F.array_sort(F.collect_list(event)).alias("events"))
    return grouped.select("stream_id", "base_version", F.to_json(F.struct(F.concat_ws("@", "stream_id", "base_version").alias("commitId"), F.col("stream_id").alias("streamId"), F.col("base_version").alias("baseVersion"), "events")).alias("body"))


def chunk_documents(events: DataFrame, n: int, byte_cap: int, prefix: str = "") -> DataFrame:
    """``events`` with chunk_base -> stream_id, chunk_base, body: the JSON document of each chunk, its
    commits in order, with the policy and the path of the last commit (a chunk has few commits)."""
    event = F.struct("version", "id", "type", "data")
    commits = events.groupBy("stream_id", "chunk_base", "base_version").agg(F.array_sort(F.collect_list(event)).alias("events"))
    commit = F.struct(F.col("base_version").alias("baseVersion"), F.concat_ws("@", "stream_id", "base_version").alias("commitId"), F.col("stream_id").alias("streamId"), "events")
    grouped = commits.groupBy("stream_id", "chunk_base").agg(F.array_sort(F.collect_list(commit)).alias("commits"), F.max("base_version").alias("last"))
    body = F.struct(F.col("stream_id").alias("streamId"), F.col("chunk_base").alias("chunkBase"), F.lit(n).alias("n"), F.lit(byte_cap).alias("byteCap"), "commits", commit_path(prefix, F.col("stream_id"), F.col("last")).alias("lastCommitKey"))
    return grouped.select("stream_id", "chunk_base", F.to_json(body).alias("body"))


def key_bucket_faults(settings: DataFrame) -> DataFrame:
    """``settings`` (bucket, versioning, replicated, object_lock) -> bucket, fault: where deleted keys
    would live on, erasure is no erasure."""
    fault: Column = (
        F.when(F.col("versioning").isin("Enabled", "Suspended"), "versioning")
        .when(F.col("replicated"), "replication")
        .when(F.col("object_lock"), "object lock")
    )
    return settings.select("bucket", fault.alias("fault"))
