"""The registered queries over event streams and their DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import admission, crypto, feed, integrity, keystore, layout, replay, shred, transform
from ..sources import documents
from . import views as V
from .views import sql

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
PAGE, N = 20, 20
EVENT = ["stream_id", "version", "id", "type", "data"]


def query(text: str, *views: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        FOUND[f.__name__] = f
        SQL[f.__name__] = sql(text, *views)
        return f

    return register


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that executors share; only a local session may do without the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = top or tempfile.mkdtemp(prefix="strandbook-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, name: str, df: DataFrame, stream: str = "stream_id", version: str = "version") -> DataFrame:
    """``df`` written once to the shared folder, by stream and version, and read from there."""
    at = shared(spark, name)
    df.repartition(stream).sortWithinPartitions(stream, version).write.parquet(at)
    return spark.read.parquet(at)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit stream: several tables are made of it, so it is written once."""
    return stored(spark, "audit", V.audit_events(spark, d), "subject", "position")


# -- replay and heads ------------------------------------------------------------------------

COLS = "stream_id, version, id, type, data"


@query(f"SELECT {COLS} FROM se", "se")
def replay_all(spark, d):
    return replay.replay(V.stream_events(spark, d)).select(*EVENT)


@query(f"SELECT {COLS} FROM se WHERE version >= 17", "se")
def replay_from_version(spark, d):
    return replay.replay(V.stream_events(spark, d), 17).select(*EVENT)


@query(f"SELECT {COLS} FROM se WHERE version >= 5 AND version < 25", "se")
def replay_window(spark, d):
    return replay.replay(V.stream_events(spark, d), 5, 25).select(*EVENT)


@query("SELECT stream_id, version, base_version, id FROM ce WHERE version >= 11", "ce")
def replay_mid_commit(spark, d):
    return replay.replay(V.commit_events(spark, d), 11).select("stream_id", "version", "base_version", "id")


@query(f"SELECT {COLS} FROM se JOIN hd USING (stream_id) WHERE version > head - 5", "se", "hd")
def recent_k_per_stream(spark, d):
    return replay.latest(V.stream_events(spark, d), 5).select(*EVENT)


@query("SELECT stream_id, head AS version FROM hd", "hd")
def stream_heads(spark, d):
    return replay.heads(V.stream_events(spark, d))


@query("SELECT stream_id, head AS version, (head // 20) * 20 AS head, '\"v' || head || '\"' AS etag FROM hd", "hd")
def head_resource(spark, d):
    log = V.stream_events(spark, d)
    return replay.head_resource(log, log.select("stream_id").distinct(), PAGE)


ASKED = "(SELECT 'user-' || o_custkey AS stream_id FROM orders GROUP BY ALL)"


@query(f"SELECT r.stream_id, head AS version, coalesce((head // 20) * 20, 0) AS head, CASE WHEN head IS NULL THEN '\"empty\"' ELSE '\"v' || head || '\"' END AS etag FROM {ASKED} r LEFT JOIN hd USING (stream_id)", "hd")
def head_absent_streams(spark, d):
    asked = V.table(spark, d, "orders").select(F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("stream_id")).distinct()
    return replay.head_resource(V.stream_events(spark, d), asked, PAGE)


@query("SELECT stream_id, CASE WHEN head % 2 = 0 THEN 304 ELSE 200 END AS status FROM hd", "hd")
def head_poll_status(spark, d):
    log = V.stream_events(spark, d)
    found = replay.head_resource(log, log.select("stream_id").distinct(), PAGE)
    known = F.concat(F.lit('"v'), (F.col("version") - F.col("version") % 2).cast("string"), F.lit('"'))
    return replay.poll_status(found, known).select("stream_id", "status")


@query("SELECT stream_id, version FROM (SELECT *, lag(value) OVER (PARTITION BY stream_id ORDER BY version) AS before FROM se) WHERE before > value", "se")
def ts_regressions(spark, d):
    return replay.time_regressions(V.stream_events(spark, d), "value").select("stream_id", "version")


# -- keys ------------------------------------------------------------------------------------


@query(
    "SELECT stream_id, base_version, 'p/streams/' || stream_id || '/e/' || lpad(CAST(base_version AS VARCHAR), 12, '0') || '.json' AS path, 'p/streams/' || stream_id || '/c/' || lpad(CAST((base_version // 20) * 20 AS VARCHAR), 12, '0') || '.json' AS chunk, 'p/streams/' || stream_id || '/head.json' AS head, base_version AS parsed, lpad(CAST(commit_seq AS VARCHAR), 6, '0') AS key_id, commit_seq AS generation FROM cm",
    "cm",
)
def key_codec(spark, d):
    c = layout.commit_table(V.commit_events(spark, d))
    s, b = F.col("stream_id"), F.col("base_version")
    c = c.withColumn("path", K.commit_path("p", s, b)).withColumn("key_id", K.generation_id(F.col("commit_seq")))
    return c.select("stream_id", "base_version", "path", K.chunk_path("p", s, K.bucket_base(b, 20)).alias("chunk"), K.head_path("p", s).alias("head"), K.base_of(F.col("path")).alias("parsed"), "key_id", K.generation_of(F.col("key_id")).alias("generation"))


NAMES = "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a/' || event_id WHEN 2 THEN '$' || event_id ELSE 's' || event_id END"


@query(f"SELECT event_id, {NAMES} AS name, event_id % 5 > 2 AS valid, event_id % 5 > 1 AS valid_reserved FROM events")
def stream_id_validation(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.expr(NAMES).alias("name"))
    return e.withColumns({"valid": K.valid_stream_id(F.col("name")), "valid_reserved": K.valid_stream_id(F.col("name"), True)})


@query("SELECT event_id, CASE WHEN value - 50 <= 0 THEN 0 ELSE CAST(floor((value - 50) / 7) AS BIGINT) * 7 END AS page_from FROM events")
def canonical_from(spark, d):
    return V.table(spark, d, "events").select("event_id", K.canonical_from(F.col("value") - 50, 7).alias("page_from"))


# -- layouts ---------------------------------------------------------------------------------


def _commits(spark, d):
    return layout.commit_table(V.commit_events(spark, d))


@query("SELECT stream_id, commit_seq, base_version, commit_size, last_version FROM cm", "cm")
def commit_envelopes(spark, d):
    return _commits(spark, d)


CHUNKS = "SELECT stream_id, min(base_version) AS chunk_base, {n} AS n, count(*) AS commits, max(last_version) AS last_version, count(*) >= {n} AS sealed FROM cm GROUP BY stream_id, commit_seq // {n}"


@query(CHUNKS.format(n="CAST(4 AS BIGINT)"), "cm")
def tail_chunks(spark, d):
    return layout.tail_chunks(_commits(spark, d), 4)


@query("SELECT stream_id, min(base_version) AS chunk_base, n, count(*) AS commits, max(last_version) AS last_version, count(*) >= n AS sealed FROM (SELECT *, CAST(2 + length(stream_id) % 3 AS BIGINT) AS n FROM cm) GROUP BY stream_id, n, commit_seq // n", "cm")
def tail_chunks_policy(spark, d):
    return layout.tail_chunks(_commits(spark, d), 2 + F.length("stream_id") % 3)


BYTES = "bs AS (SELECT stream_id, commit_seq, base_version, CAST(sum(length(data) * 10) AS BIGINT) AS bytes FROM ce GROUP BY ALL), fo AS (SELECT stream_id, commit_seq, base_version AS chunk_base, base_version, 1 AS c, bytes AS held FROM bs WHERE commit_seq = 0 UNION ALL SELECT b.stream_id, b.commit_seq, CASE WHEN f.c >= 6 OR f.held >= 700 THEN b.base_version ELSE f.chunk_base END, b.base_version, CASE WHEN f.c >= 6 OR f.held >= 700 THEN 1 ELSE f.c + 1 END, CASE WHEN f.c >= 6 OR f.held >= 700 THEN b.bytes ELSE f.held + b.bytes END FROM fo f JOIN bs b ON b.stream_id = f.stream_id AND b.commit_seq = f.commit_seq + 1)"


@query("SELECT 1", "ce")
def tail_chunks_bytecap(spark, d):
    e = V.commit_events(spark, d)
    c = e.groupBy("stream_id", "commit_seq", "base_version").agg(F.sum(F.octet_length("data") * 10).cast("long").alias("bytes"))
    return layout.roll_by_size(c, "bytes", 6, 700).select("stream_id", "commit_seq", "base_version", "chunk_base")


SQL["tail_chunks_bytecap"] = sql("", "ce").rstrip() + f", {BYTES} SELECT stream_id, commit_seq, base_version, chunk_base FROM fo"


POLICY = "bs AS (SELECT stream_id, commit_seq, base_version, CAST(sum(length(data) * 10) AS BIGINT) AS bytes, CASE WHEN commit_seq = 0 AND length(stream_id) % 2 = 0 THEN 2 WHEN commit_seq = 3 THEN 99 END AS cn, CASE WHEN commit_seq % 7 = 5 THEN 4 END AS pn, CASE WHEN commit_seq % 11 = 6 THEN 300 END AS pc FROM ce GROUP BY ALL), fo AS (SELECT stream_id, commit_seq, base_version AS chunk_base, base_version, 1 AS c, bytes AS held, coalesce(cn, pn, 3) AS n, coalesce(pc, 700) AS cap FROM bs WHERE commit_seq = 0 UNION ALL SELECT b.stream_id, b.commit_seq, CASE WHEN full_ THEN b.base_version ELSE f.chunk_base END, b.base_version, CASE WHEN full_ THEN 1 ELSE f.c + 1 END, CASE WHEN full_ THEN b.bytes ELSE f.held + b.bytes END, CASE WHEN full_ THEN coalesce(pn, n) ELSE n END, CASE WHEN full_ THEN coalesce(pc, cap) ELSE cap END FROM (SELECT *, c >= n OR held >= cap AS full_ FROM fo) f JOIN bs b ON b.stream_id = f.stream_id AND b.commit_seq = f.commit_seq + 1)"


@query("SELECT 1", "ce")
def tail_chunks_mint_policy(spark, d):
    """Chunk policies: asked for at creation, by the resolver, carried on, or the default."""
    e = V.commit_events(spark, d)
    seq, none = F.col("commit_seq"), F.lit(None).cast("long")
    c = e.groupBy("stream_id", "commit_seq", "base_version").agg(F.sum(F.octet_length("data") * 10).cast("long").alias("bytes"))
    c = c.withColumns({"create_n": F.when((seq == 0) & (F.length("stream_id") % 2 == 0), 2).when(seq == 3, 99), "policy_n": F.when(seq % 7 == 5, 4), "create_cap": none, "policy_cap": F.when(seq % 11 == 6, 300)})
    return layout.roll_by_policy(c, 3, 700)


SQL["tail_chunks_mint_policy"] = sql("", "ce").rstrip() + f", {POLICY} SELECT stream_id, commit_seq, base_version, chunk_base, CAST(n AS BIGINT) AS n, CAST(cap AS BIGINT) AS byte_cap FROM fo"


STEP = "SELECT stream_id, CAST(CASE WHEN length(stream_id) % 2 = 0 THEN 10 ELSE 0 END AS BIGINT) AS bucket, CASE WHEN top < CASE WHEN length(stream_id) % 2 = 0 THEN 20 ELSE 10 END THEN 'nothing-to-do' WHEN top % 3 = 0 THEN 'stood-down' ELSE 'compacted' END AS status FROM (SELECT stream_id, max(base_version) AS top FROM cm GROUP BY stream_id)"


def _step(spark, d):
    """Even streams have the chunk of their first bucket listed; some have got another one since.

    The commits are written once: the tail, the listed chunks and those that raced are all made of them."""
    commits = stored(spark, "step-commits", _commits(spark, d), version="base_version")
    top = commits.groupBy("stream_id").agg(F.max("base_version").alias("top"), F.max(F.when(F.col("base_version") < 10, F.col("last_version"))).alias("last_version"))
    listed = top.where("length(stream_id) % 2 = 0").select("stream_id", F.lit(0).cast("long").alias("chunk_base"), "last_version")
    raced = top.where("top % 3 = 0").select("stream_id", F.when(F.length("stream_id") % 2 == 0, 10).otherwise(0).cast("long").alias("chunk_base"))
    tail = commits.join(listed.select("stream_id", F.lit(True).alias("gone")), "stream_id", "left").where("gone IS NULL OR base_version >= 10").drop("gone")
    return tail, layout.compaction_outcomes(tail, listed.drop("last_version").unionByName(raced), listed, 10)


@query(STEP, "cm")
def compaction_outcomes(spark, d):
    return _step(spark, d)[1]


@query(f"SELECT c.stream_id, c.base_version FROM cm c JOIN ({STEP}) s USING (stream_id) WHERE c.base_version >= CASE WHEN length(c.stream_id) % 2 = 0 THEN 10 ELSE 0 END AND NOT (s.status <> 'nothing-to-do' AND (c.base_version // 10) * 10 = s.bucket)", "cm")
def compaction_leaves(spark, d):
    """Commits that are left when the sources of the step's chunks are gone."""
    tail, outcomes = _step(spark, d)
    return layout.without_sources(tail, outcomes, 10).select("stream_id", "base_version")


@query("SELECT stream_id, version, id FROM ce WHERE version >= 30", "ce")
def chunk_pruned_replay(spark, d):
    e = V.commit_events(spark, d)
    chunks = layout.tail_chunks(layout.commit_table(e), 4)
    return layout.chunk_pruned(e, chunks, 30).select("stream_id", "version", "id")


BUCKET = "(SELECT *, (base_version // 10) * 10 AS bucket FROM cm)"
SEALED = f"SELECT stream_id, bucket, count(*) AS commits, CAST(sum(commit_size) AS BIGINT) AS events, min(base_version) AS first_base, max(base_version) AS last_base, (SELECT max(base_version) FROM cm x WHERE x.stream_id = b.stream_id) >= bucket + 10 AS sealed FROM {BUCKET} b GROUP BY ALL"


@query("SELECT stream_id, commit_seq, base_version, bucket FROM " + BUCKET, "cm")
def bucket_assignment(spark, d):
    return _commits(spark, d).select("stream_id", "commit_seq", "base_version", K.bucket_base(F.col("base_version"), 10).alias("bucket"))


@query(SEALED, "cm")
def sealed_buckets(spark, d):
    return layout.sealed_buckets(_commits(spark, d), 10)


@query(f"SELECT stream_id, min(bucket) AS bucket FROM ({SEALED}) WHERE sealed AND NOT (bucket = 0 AND length(stream_id) % 2 = 0) GROUP BY stream_id", "cm")
def compaction_plan(spark, d):
    buckets = layout.sealed_buckets(_commits(spark, d), 10)
    done = buckets.where("bucket = 0 AND length(stream_id) % 2 = 0").select("stream_id", F.col("bucket").alias("chunk_base"))
    return layout.compaction_plan(buckets, done)


@query("SELECT stream_id, commit_seq, base_version, base_version >= 10 + 10 * (length(stream_id) % 2) AS suggested FROM cm", "cm")
def compaction_suggested(spark, d):
    return layout.compaction_suggested(_commits(spark, d), 10 * (F.length("stream_id") % 2), 10).select("stream_id", "commit_seq", "base_version", "suggested")


@query("SELECT stream_id, version, id FROM ce", "ce")
def compacted_read(spark, d):
    """Chunks of sealed buckets, with the whole tail still there: nothing is read twice."""
    e = stored(spark, "commit-events", V.commit_events(spark, d))
    chunked = layout.compact(e, layout.sealed_buckets(layout.commit_table(e), 10), 10)
    return layout.compacted_read(chunked, e, 10).select("stream_id", "version", "id")


@query("SELECT stream_id, base_version FROM cm JOIN hd USING (stream_id) WHERE base_version < (head // 10) * 10", "cm", "hd")
def sweep_garbage(spark, d):
    e = V.commit_events(spark, d)
    mark = replay.heads(e).select("stream_id", K.bucket_base(F.col("version"), 10).alias("watermark"))
    return layout.garbage(layout.commit_table(e), mark).select("stream_id", "base_version")


@query("SELECT n, CAST(sum((head + n) // n) AS BIGINT) AS chunk_gets, CAST(sum(head + 1) AS BIGINT) AS events FROM hd, (SELECT unnest([5, 20, 100, 500]) AS n) GROUP BY n", "hd")
def replay_cost_by_n(spark, d):
    """Chunk reads of a full replay for several chunk widths: ceil(events / n) for each stream."""
    h = replay.heads(V.stream_events(spark, d)).select("version", F.explode(F.array(*map(F.lit, (5, 20, 100, 500)))).alias("n"))
    return h.groupBy("n").agg(F.sum(F.expr("(version + n) div n")).alias("chunk_gets"), F.sum(F.col("version") + 1).alias("events"))


@query("SELECT stream_id, version, id, type, data, base_version FROM ce", "ce")
def json_commit_source(spark, d):
    """Commit documents written as JSON text and read back: payloads stay verbatim."""
    at = shared(spark, "commits")
    documents.commit_documents(V.commit_events(spark, d)).select("body").write.text(at)
    return documents.read_commits(spark, at, whole_files=False).select("stream_id", "version", "id", "type", "data", "base_version")


@query("SELECT stream_id, (base_version // 10) * 10 AS chunk_base, version, id, data, 'p/streams/' || stream_id || '/e/' || lpad(CAST(last AS VARCHAR), 12, '0') || '.json' AS last_commit FROM (SELECT *, max(base_version) OVER (PARTITION BY stream_id, base_version // 10) AS last, max(base_version) OVER (PARTITION BY stream_id) AS top FROM ce) WHERE top >= (base_version // 10) * 10 + 10", "ce")
def json_chunk_source(spark, d):
    """Chunk documents of all sealed buckets written as JSON text and read back."""
    e = V.commit_events(spark, d)
    at = shared(spark, "chunks")
    documents.chunk_documents(layout.compact(e, layout.sealed_buckets(layout.commit_table(e), 10), 10), 10, 0, "p").select("body").write.text(at)
    last = spark.read.schema(documents.CHUNK).json(at).select(F.col("streamId").alias("stream_id"), F.col("chunkBase").alias("chunk_base"), F.col("lastCommitKey").alias("last_commit"))
    events = documents.read_chunks(spark, at, whole_files=False).withColumn("chunk_base", K.bucket_base(F.col("base_version"), 10))
    return events.join(last, ["stream_id", "chunk_base"]).select("stream_id", "chunk_base", "version", "id", "data", "last_commit")


@query(f"SELECT {COLS} FROM se WHERE version >= 5 AND version < 25", "se")
def stored_replay_window(spark, d):
    """A window of a log that was written once, sorted by stream: the filter reaches the Parquet scan."""
    log = stored(spark, "stored-log", V.stream_events(spark, d).select(*EVENT))
    return replay.replay(log, 5, 25)


@query("SELECT stream_id, version, id FROM se WHERE version >= 3 AND ts >= TIMESTAMP '2024-01-10 00:00:00'", "se")
def client_time_filter(spark, d):
    moment = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return replay.since(V.stream_events(spark, d), moment, 3).select("stream_id", "version", "id")


@query("SELECT stream_id, base_version, expected FROM (SELECT stream_id, base_version, commit_size, coalesce(lag(base_version + commit_size) OVER (PARTITION BY stream_id ORDER BY base_version), 0) AS expected FROM cm WHERE (base_version + length(stream_id)) % 13 <> 0) WHERE base_version <> expected", "cm")
def contiguity_check(spark, d):
    """With some commits taken away, so that there is something to find."""
    c = _commits(spark, d).where("(base_version + length(stream_id)) % 13 <> 0")
    return layout.discontiguous(c).select("stream_id", "base_version", "expected")


@query("SELECT r_name AS bucket, CASE WHEN r_regionkey IN (1, 2) THEN 'versioning' WHEN r_regionkey = 3 THEN 'replication' END AS fault FROM region")
def key_bucket_config(spark, d):
    r = V.table(spark, d, "region")
    s = r.select(F.col("r_name").alias("bucket"), F.when(F.col("r_regionkey") == 1, "Enabled").when(F.col("r_regionkey") == 2, "Suspended").otherwise("Off").alias("versioning"), (F.col("r_regionkey") == 3).alias("replicated"), F.lit(False).alias("object_lock"))
    return documents.key_bucket_faults(s)


# -- feed ------------------------------------------------------------------------------------

PAGES = "SELECT stream_id, (version // 20) * 20 AS page_from, count(*) AS n_events, any_value(head) AS head FROM se JOIN hd USING (stream_id) GROUP BY ALL"
PAGES = PAGES.replace("GROUP BY ALL", "GROUP BY stream_id, (version // 20) * 20")
SHAPE = "page_from + 20 AS page_to, coalesce(head, -1) >= page_from + 20 AS complete"


@query(f"SELECT stream_id, page_from, n_events, {SHAPE}, CASE WHEN head >= page_from + 20 THEN page_from + 20 END AS next, CASE WHEN page_from > 0 THEN page_from - 20 END AS prev FROM ({PAGES})", "se", "hd")
def feed_pages(spark, d):
    return feed.pages(V.stream_events(spark, d), PAGE)


@query(f"SELECT stream_id, page_from, n_events, {SHAPE}, CASE WHEN head >= page_from + 20 THEN '/feed/' || stream_id || '?from=' || (page_from + 20) END AS next, CASE WHEN page_from > 0 THEN '/feed/' || stream_id || '?from=' || (page_from - 20) END AS prev FROM ({PAGES})", "se", "hd")
def wire_feed(spark, d):
    return feed.wire(feed.pages(V.stream_events(spark, d), PAGE), "/feed")


REQ = "SELECT o_orderkey, 'user-' || o_custkey AS stream_id, o_orderkey % 130 - 5 AS requested, CASE WHEN o_orderkey % 130 - 5 <= 0 THEN 0 ELSE ((o_orderkey % 130 - 5) // 20) * 20 END AS page_from FROM orders"


def _requests(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("stream_id"), (F.col("o_orderkey") % 130 - 5).alias("requested"))


@query(f"SELECT r.o_orderkey, r.stream_id, requested, r.page_from, requested <> r.page_from AS redirect, coalesce(n_events, 0) AS n_events, r.page_from + 20 AS page_to, coalesce(hd.head, -1) >= r.page_from + 20 AS complete, CASE WHEN hd.head >= r.page_from + 20 THEN r.page_from + 20 END AS next, CASE WHEN r.page_from > 0 THEN r.page_from - 20 END AS prev FROM ({REQ}) r LEFT JOIN hd USING (stream_id) LEFT JOIN ({PAGES}) p ON p.stream_id = r.stream_id AND p.page_from = r.page_from", "se", "hd")
def page_requests(spark, d):
    return feed.page_requests(V.stream_events(spark, d), _requests(spark, d), PAGE)


@query(f"SELECT o_orderkey, page_from FROM ({REQ}) WHERE requested <> page_from")
def redirects(spark, d):
    return feed.page_requests(V.stream_events(spark, d), _requests(spark, d), PAGE).where("redirect").select("o_orderkey", "page_from")


@query(
    f"SELECT p.stream_id, p.page_from, ids, p.page_from + 20 AS page_to, head >= p.page_from + 20 AS complete, CASE WHEN head >= p.page_from + 20 THEN '/feed/' || p.stream_id || '?from=' || (p.page_from + 20) END AS next, CASE WHEN p.page_from > 0 THEN '/feed/' || p.stream_id || '?from=' || (p.page_from - 20) END AS prev FROM ({PAGES}) p JOIN (SELECT stream_id, (version // 20) * 20 AS page_from, string_agg(id, ',' ORDER BY version) AS ids FROM se GROUP BY ALL) i ON i.stream_id = p.stream_id AND i.page_from = p.page_from",
    "se", "hd",
)
def wire_page_documents(spark, d):
    """JSON page documents, parsed again."""
    body = feed.page_documents(V.stream_events(spark, d), PAGE, "/feed", ["version", "id", "type", "data"])
    e = F.from_json("body", "struct<streamId:string,from:bigint,to:bigint,complete:boolean,events:array<struct<version:bigint,id:string>>,next:string,prev:string>")
    return body.select(e["streamId"].alias("stream_id"), e["from"].alias("page_from"), F.array_join(F.transform(e["events"], lambda x: x["id"]), ",").alias("ids"), e["to"].alias("page_to"), e["complete"].alias("complete"), e["next"].alias("next"), e["prev"].alias("prev"))


@query(f"SELECT r.stream_id, head AS version, '/feed/' || r.stream_id || '?from=' || coalesce((head // 20) * 20, 0) AS head, CASE WHEN head IS NULL THEN '\"empty\"' ELSE '\"v' || head || '\"' END AS etag FROM {ASKED} r LEFT JOIN hd USING (stream_id)", "hd")
def wire_head_documents(spark, d):
    asked = V.table(spark, d, "orders").select(F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("stream_id")).distinct()
    body = feed.head_documents(replay.head_resource(V.stream_events(spark, d), asked, PAGE), "/feed")
    e = F.from_json("body", "struct<streamId:string,version:bigint,head:string,etag:string>")
    return body.select(e["streamId"].alias("stream_id"), e["version"].alias("version"), e["head"].alias("head"), e["etag"].alias("etag"))


# -- admission -------------------------------------------------------------------------------


@query("SELECT stream_id, arrival, attempt_id, ok, base FROM ad", "ad")
def admission_outcomes(spark, d):
    return admission.admit(V.attempts(spark, d))


@query("SELECT stream_id, arrival, attempt_id, ok, base FROM ad", "ad")
def admission_sorted_streams(spark, d):
    """The same in two steps: the second half of the attempts meets the heads that the first one left."""
    a = V.attempts(spark, d)
    first = admission.admit(a.where("arrival <= 10"))
    done = first.where("ok").join(a.select("attempt_id", "n_events"), "attempt_id")
    heads = done.groupBy("stream_id").agg(F.max(F.col("base") + F.col("n_events") - 1).alias("version"))
    return first.unionByName(admission.admit(a.where("arrival > 10"), heads))


@query("SELECT stream_id, arrival, attempt_id, ok, base FROM ad", "ad")
def admission_streaming(spark, d):
    """The same decisions made by Structured Streaming over the written attempts."""
    from ..streaming.ingest import admit_stream

    at = shared(spark, "attempts")
    given = V.attempts(spark, d)
    given.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(given.schema).parquet(f"{at}/in")
    admit_stream(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("SELECT stream_id, max(head) AS version FROM ad GROUP BY stream_id HAVING max(head) >= 0", "ad")
def admission_heads(spark, d):
    a = V.attempts(spark, d)
    good = admission.admit(a).where("ok").join(a.select("attempt_id", "n_events"), "attempt_id")
    return good.groupBy("stream_id").agg(F.max(F.col("base") + F.col("n_events") - 1).alias("version"))


@query("SELECT attempt_id, CASE WHEN attempt_id % 11 = 0 THEN 'too many events' WHEN attempt_id % 13 = 0 THEN 'expected version' END AS invalid FROM att", "att")
def append_validation(spark, d):
    a = V.attempts(spark, d).withColumn("n_events", F.when(F.col("attempt_id") % 11 == 0, 21).otherwise(F.col("n_events")))
    a = a.withColumn("expected_kind", F.when(F.col("attempt_id") % 13 == 0, "version").otherwise(F.col("expected_kind"))).withColumn("expected_version", F.when(F.col("attempt_id") % 13 == 0, -1).otherwise(F.col("expected_version")))
    return admission.validated(a).select("attempt_id", "invalid")


@query("SELECT stream_id, id, base + pos AS version, pos FROM (SELECT stream_id, attempt_id, base, unnest(range(1 + attempt_id % 3)) AS pos, attempt_id || '-' || pos AS id FROM ad WHERE ok)", "ad")
def committed_events(spark, d):
    a = V.attempts(spark, d)
    pay = a.select("stream_id", "attempt_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_events") - 1)).alias("pos")).withColumns({"id": F.concat_ws("-", "attempt_id", "pos"), "type": F.lit("T"), "data": F.lit("1"), "ts": F.lit(None).cast("string")})
    return admission.committed_events(admission.admit(a), pay, F.lit("2024-01-01T00:00:00Z")).select("stream_id", "id", "version", "pos")


SQL["committed_events"] = sql("SELECT stream_id, attempt_id || '-' || pos AS id, base + pos AS version, pos FROM (SELECT stream_id, attempt_id, base, unnest(range(1 + attempt_id % 3)) AS pos FROM ad WHERE ok)", "ad")


@query("SELECT base_version || '@' || stream_id AS attempt_id, bool_and(NOT (event_id % 7 = 0)) AS already_committed FROM ce GROUP BY stream_id, base_version", "ce")
def idempotent_retry(spark, d):
    """Every commit is tried again; events divisible by 7 come with another id."""
    e = V.commit_events(spark, d)
    again = e.select(F.concat_ws("@", "base_version", "stream_id").alias("attempt_id"), "stream_id", F.col("base_version").alias("base"), (F.col("version") - F.col("base_version")).alias("pos"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"))
    return admission.idempotent_retry(again, e)


AGAIN = """SELECT *, CASE WHEN k = 0 THEN 'refused' WHEN k = 1 THEN 'refused' WHEN k = 2 THEN 'refused' WHEN appended THEN 'appended' WHEN same THEN 'alreadyCommitted' ELSE 'conflict' END AS outcome FROM (
  SELECT stream_id, base_version, CAST(count(*) AS BIGINT) AS n, base_version % 7 AS k, bool_and(event_id % 5 <> 0) AS same, base_version > top - 0 AS appended
  FROM (SELECT *, max(base_version) OVER (PARTITION BY stream_id) AS top FROM ce) GROUP BY stream_id, base_version, top)"""


@query(f"SELECT base_version || '@' || stream_id AS attempt_id, outcome, CASE WHEN outcome = 'alreadyCommitted' THEN base_version END AS base, CASE WHEN outcome = 'alreadyCommitted' THEN base_version + n - 1 END AS next_expected FROM ({AGAIN})", "ce")
def idempotent_append(spark, d):
    """Every commit is tried again: some without events, without ids or for any version, some with other ids."""
    e = V.commit_events(spark, d)
    events = e.select(F.concat_ws("@", "base_version", "stream_id").alias("attempt_id"), "base_version", (F.col("version") - F.col("base_version")).alias("pos"), F.when(F.col("base_version") % 7 == 1, None).when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"))
    kind = F.when(F.col("base_version") % 7 == 2, "any").when(F.col("base_version") == 0, "noStream").otherwise("version")
    tries = layout.commit_table(e).select(F.concat_ws("@", "base_version", "stream_id").alias("key"), "stream_id", F.col("commit_seq").alias("arrival"), kind.alias("expected_kind"), (F.col("base_version") - 1).alias("expected_version"))
    number = F.xxhash64("key")
    out = admission.idempotent_append(tries.withColumn("attempt_id", number), events.where("base_version % 7 <> 0").withColumn("attempt_id", F.xxhash64("attempt_id")), e)
    return tries.withColumn("number", number).join(out.withColumnRenamed("attempt_id", "number"), "number").select(F.col("key").alias("attempt_id"), "outcome", "base", "next_expected")


@query("SELECT base_version || '@' || stream_id AS attempt_id, min(version) > 9 AS already_committed FROM ce GROUP BY stream_id, base_version", "ce")
def forward_scan_retry(spark, d):
    e = V.commit_events(spark, d)
    again = e.select(F.concat_ws("@", "base_version", "stream_id").alias("attempt_id"), "stream_id", F.lit(9).alias("client_version"), "id")
    return admission.forward_scan_retry(again, e)


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def lost_response_dedup(spark, d):
    e = V.stream_events(spark, d).select("event_id", F.col("id").alias("commit_id"))
    return admission.without_known(e, e.where("event_id % 5 = 0")).select("event_id")


# -- transforms ------------------------------------------------------------------------------


@query("SELECT stream_id, version, CASE WHEN type = 'view' THEN 'viewed' ELSE type END AS type, CAST(json_extract_string(data, '$.k') AS BIGINT) + CASE WHEN type = 'view' THEN 1 ELSE 0 END AS k FROM se", "se")
def upcast_events(spark, d):
    def parse(x: DataFrame) -> DataFrame:
        return x.withColumn("k", F.get_json_object("data", "$.k").cast("long"))

    def rename(x: DataFrame) -> DataFrame:
        old = F.col("type") == "view"
        return x.withColumn("k", F.col("k") + old.cast("long")).withColumn("type", F.when(old, "viewed").otherwise(F.col("type")))

    return transform.upcast(V.stream_events(spark, d), [parse, rename]).select("stream_id", "version", "type", "k")


CENTS = "cast(round(value * 100) as bigint)"
CENTS_SQL = "CAST(round(value * 100) AS BIGINT)"


@query(f"SELECT stream_id, max(version) AS version, CAST(sum({CENTS_SQL}) AS BIGINT) AS cents FROM se GROUP BY stream_id", "se")
def fold_sum(spark, d):
    return transform.fold_by_aggregates(V.stream_events(spark, d), cents=F.sum(F.expr(CENTS)))


@query(f"SELECT stream_id, max(version) AS version, CAST(sum({CENTS_SQL}) AS BIGINT) AS cents FROM se WHERE version >= 12 GROUP BY stream_id", "se")
def fold_from_version(spark, d):
    return transform.fold_by_aggregates(V.stream_events(spark, d), 12, cents=F.sum(F.expr(CENTS)))


@query("SELECT stream_id, type, count(*) AS n FROM se GROUP BY ALL", "se")
def fold_counts_by_type(spark, d):
    return V.stream_events(spark, d).groupBy("stream_id", "type").agg(F.count("*").alias("n"))


@query("SELECT 1", "se")
def fold_general(spark, d):
    init = F.lit(7).cast("long")
    return transform.fold_in_order(V.stream_events(spark, d), F.expr(CENTS), init, lambda s, x: F.pmod(s * 31 + x, F.lit(1_000_003)))


@query("SELECT 1", "se")
def fold_long_streams(spark, d):
    """The same fold over sorted streams, for streams of any length."""
    return transform.fold_sorted(V.stream_events(spark, d), F.expr(CENTS), 7, lambda s, x: (s * 31 + x) % 1_000_003, "long")


@query(f"SELECT h.stream_id, coalesce(max(version), 39) AS version, coalesce(CAST(sum({CENTS_SQL}) AS BIGINT), 0) + 5 AS state FROM hd h LEFT JOIN (SELECT * FROM se WHERE version >= 40) s USING (stream_id) GROUP BY h.stream_id", "se", "hd")
def fold_empty_ranges(spark, d):
    """Streams without events from version 40 on give the initial state at version 39."""
    log = V.stream_events(spark, d)
    return transform.fold_in_order(log, F.expr(CENTS), F.lit(5).cast("long"), lambda s, x: s + x, 40, replay.heads(log))


SQL["fold_general"] = SQL["fold_long_streams"] = sql("", "se").rstrip() + f", fg AS (SELECT stream_id, version, (7 * 31 + {CENTS_SQL}) % 1000003 AS state FROM se WHERE version = 0 UNION ALL SELECT s.stream_id, s.version, (f.state * 31 + {CENTS_SQL}) % 1000003 FROM fg f JOIN se s ON s.stream_id = f.stream_id AND s.version = f.version + 1) SELECT stream_id, max(version) AS version, arg_max(state, version) AS state FROM fg GROUP BY stream_id"


# -- encryption ------------------------------------------------------------------------------


def _stream_keys(log: DataFrame) -> DataFrame:
    return log.select("stream_id").distinct().select("stream_id", K.generation_id(F.lit(0)).alias("key_id"), F.unhex(F.sha2("stream_id", 256)).alias("key"))


@query("SELECT stream_id, version, 'ok' AS status, data FROM se", "se")
def encrypt_roundtrip_payload(spark, d):
    log = V.stream_events(spark, d).select(*EVENT)
    keys = _stream_keys(log)
    secret = crypto.encrypt_payloads(log, keys)
    return crypto.decrypt_payloads(secret, keys, compressed=False).select("stream_id", "version", "status", "data")


@query("SELECT stream_id, version, 'ok' AS status, data FROM se", "se")
def encrypt_roundtrip_compressed(spark, d):
    log = V.stream_events(spark, d).select(*EVENT)
    keys = _stream_keys(log)
    secret = crypto.encrypt_payloads(log, keys, compress=True)
    return crypto.decrypt_payloads(secret, keys).select("stream_id", "version", "status", "data")


def _field_keys(log: DataFrame) -> DataFrame:
    """A key for each subject (there are as many as roles)."""
    return log.select("subject").distinct().select("subject", F.unhex(F.sha2("subject", 256)).alias("key"))


ROLE = crypto.subject_in("role")


def _annotated(spark) -> DataFrame:
    return spark.createDataFrame([("said", ["text"], False), ("structure", None, True)], "type string, fields array<string>, plaintext boolean")


def _said(spark, d) -> DataFrame:
    """Conversations as events whose data is an object with a role, a turn and the text."""
    log = V.conv_events(spark, d)
    return log.select("stream_id", "version", F.lit("said").alias("type"), F.to_json(F.struct(F.col("subject").alias("role"), F.col("version").alias("turn"), "text")).alias("data"))


def _secret(spark, d) -> tuple[DataFrame, DataFrame]:
    log = _said(spark, d)
    keys = _field_keys(V.conv_events(spark, d)).withColumn("key_id", F.lit("000000"))
    passed = crypto.gated(log, _annotated(spark), ROLE).where("reason IS NULL")
    return crypto.encrypt_fields(passed, keys), keys.withColumn("status", F.lit("ok"))


def _parts(log: DataFrame) -> DataFrame:
    return log.select("stream_id", "version", *[F.get_json_object("data", f"$.{c}").alias(c) for c in ("role", "turn", "text")])


SAID = "SELECT stream_id, version, subject AS role, CAST(version AS VARCHAR) AS turn, {} AS text FROM conv"


@query(SAID.format("text"), "conv")
def encrypt_roundtrip_field(spark, d):
    secret, keys = _secret(spark, d)
    return _parts(crypto.decrypt_fields(secret, keys, ROLE))


@query("SELECT stream_id, version, subject AS role, true AS hidden, '000000' AS key_id FROM conv", "conv")
def encrypted_fields_stored(spark, d):
    """The stored form: other fields stay plain, the event carries the key id."""
    secret, _ = _secret(spark, d)
    field = F.get_json_object("data", "$.text")
    return secret.select("stream_id", "version", F.get_json_object("data", "$.role").alias("role"), crypto.is_field_envelope(field).alias("hidden"), "key_id")


@query(SAID.format("CASE WHEN subject = 'user' THEN '{\"$shredded\":true}' ELSE text END"), "conv")
def field_mask_shredded(spark, d):
    secret, keys = _secret(spark, d)
    erased = F.col("subject") == "user"
    keys = keys.withColumns({"key": F.when(~erased, F.col("key")), "status": F.when(erased, "erased").otherwise("ok")})
    return _parts(crypto.decrypt_fields(secret, keys, ROLE))


@query("SELECT stream_id, version, CASE WHEN version % 3 = 0 AND type = 'click' THEN 'clicked' ELSE type END AS type, CAST(json_extract_string(data, '$.k') AS BIGINT) AS k FROM se WHERE version >= 4", "se")
def client_read(spark, d):
    """A third of the events plain, a third one ciphertext, a third with an encrypted field; all read alike.

    The log is written once, as it stands in storage, and read from there."""
    log = stored(spark, "client-events", V.stream_events(spark, d).select(*EVENT))
    keys = _stream_keys(log)
    plain = log.where("version % 3 = 0").withColumn("key_id", F.lit(None).cast("string"))
    whole = crypto.encrypt_payloads(log.where("version % 3 = 1"), keys, compress=True)
    whole = whole.withColumn("data", F.concat(F.lit('"'), "data", F.lit('"')))
    notes = spark.createDataFrame([(t, ["k"], False) for t in ("click", "view", "purchase", "signup", "error")], "type string, fields array<string>, plaintext boolean")
    by_stream = keys.withColumnRenamed("stream_id", "subject")
    owned = log.where("version % 3 = 2").withColumn("data", F.to_json(F.struct(F.col("stream_id").alias("owner"), F.get_json_object("data", "$.k").cast("long").alias("k"))))
    owner = crypto.subject_in("owner")
    fields = crypto.encrypt_fields(crypto.gated(owned, notes, owner).where("reason IS NULL"), by_stream)
    # by stream, so that every task of the read has its share of the ciphertexts
    written = stored(spark, "client-log", plain.unionByName(whole).unionByName(fields))

    def rename(x: DataFrame) -> DataFrame:
        return x.withColumn("type", F.when((F.col("version") % 3 == 0) & (F.col("type") == "click"), "clicked").otherwise(F.col("type")))

    read = transform.client_read(written, keys, by_stream.withColumn("status", F.lit("ok")), owner, [rename], 4)
    return read.select("stream_id", "version", "type", F.get_json_object("data", "$.k").cast("long").alias("k"))


@query("SELECT count(*) AS n, count(*) AS rejected FROM se", "se")
def transplant_rejected(spark, d):
    """A payload moved to another stream isn't accepted there."""
    log = V.stream_events(spark, d).select(*EVENT)
    keys = _stream_keys(log)
    met = crypto.encrypt_payloads(log, keys).join(keys.select("stream_id", "key"), "stream_id")
    foreign = crypto.decrypt(F.col("data"), F.col("key"), crypto.payload_aad(F.concat(F.lit("other-"), "stream_id"), F.col("key_id")), compressed=False)
    return met.agg(F.count("*").alias("n"), F.count(F.when(foreign.isNull(), 1)).alias("rejected"))


BROKEN = """CASE WHEN event_id % 17 = 0 THEN '[1, 2]' WHEN event_id % 19 = 0 THEN '"one text"'
  WHEN event_id % 13 = 0 THEN '{"note": "a"}' WHEN event_id % 11 = 0 THEN '{"who": "u1", "note": "a", "other": {"$enc": "x"}}'
  WHEN event_id % 7 = 0 THEN '{"who": "u2", "note": "a", "other": {"$shredded": true}}' WHEN event_id % 5 = 0 THEN '{"who": "u3", "note": {"$enc": "x"}, "other": {"$enc": 5}}'
  WHEN event_id % 3 = 0 THEN '{"who": "u4", "note": "a", "other": {"$shredded": "true"}}' ELSE '{"who": "u5", "note": null, "deep": {"other": {"$enc": "x"}}}' END"""
NOTES = [("click", ["note"], False), ("view", None, True), ("purchase", ["note", "who"], False), ("signup", [], False), ("error", ["no\nte"], False)]
OBJECT = "json_type(data) = 'OBJECT'"
WHO = "(CASE WHEN json_type(data) = 'OBJECT' THEN json_extract_string(data, '$.who') END)"
SHAPED = "(json_type(data, '$.other.\"$enc\"') = 'VARCHAR' OR (json_type(data, '$.other.\"$shredded\"') = 'BOOLEAN' AND json_extract_string(data, '$.other.\"$shredded\"') = 'true'))"


@query(
    f"""SELECT event_id, CASE WHEN type = 'logout' THEN 'unannotated type' WHEN type = 'view' THEN NULL WHEN type = 'signup' THEN 'empty annotation'
  WHEN {WHO} IS NULL THEN 'no subject' WHEN NOT {OBJECT} THEN 'payload is no object' WHEN type = 'error' THEN 'newline in field name'
  WHEN {SHAPED} THEN 'reserved shape' WHEN type = 'purchase' THEN 'subject is lost by encryption' END AS reason
  FROM (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'logout' ELSE type END AS type, {BROKEN} AS data FROM se)""",
    "se",
)
def serialization_gate(spark, d):
    """Payloads, annotations and subjects that break each rule."""
    notes = spark.createDataFrame(NOTES, "type string, fields array<string>, plaintext boolean")
    log = V.stream_events(spark, d).select("stream_id", "event_id", F.expr("CASE WHEN event_id % 23 = 0 THEN 'logout' ELSE type END").alias("type"), F.expr(BROKEN).alias("data"))
    return crypto.gated(log, notes, crypto.subject_in("who")).select("event_id", "reason")


REWRAP = "CASE WHEN generation % 5 = 4 THEN 'skipped' WHEN length(subject) % 3 = 0 THEN 'failed' WHEN generation % 2 = 1 THEN 'alreadyCurrent' WHEN generation % 7 = 6 THEN 'skipped' ELSE 'rewrapped' END"


@query(f"SELECT subject, generation, {REWRAP} AS status FROM kg", "kg")
def rewrap_report(spark, d):
    """Odd generations are under the new master already; some keys were moved from another path, some are
    gone since they were listed, some change under the writer."""
    g = V.key_generations(spark, d).withColumn("path", K.generation_path(F.col("subject"), F.col("generation")))
    g = g.withColumns({"own": K.key_of(F.col("path")), "old_master": F.unhex(F.sha2(F.lit("old"), 256)), "new_master": F.unhex(F.sha2(F.lit("new"), 256))})
    master = F.when(F.col("generation") % 2 == 1, F.col("new_master")).otherwise(F.col("old_master"))
    path = F.when(F.length("subject") % 3 == 0, F.lit("elsewhere")).otherwise(F.col("own.subject"))
    g = g.withColumn("wrapped", F.when(F.col("generation") % 5 != 4, crypto.wrap(F.col("key"), master, path, F.col("own.key_id"))))
    g = g.select("own.subject", "own.key_id", "generation", "wrapped", "old_master", "new_master", (F.col("generation") % 7 == 6).alias("moved"))
    return crypto.rewrap(g).select("subject", "generation", "status")


# -- key store and shredding -----------------------------------------------------------------


def _stones(spark, d):
    return shred.tombstones(_audit(spark, d))


@query("SELECT subject, max(generation) AS generation, lpad(CAST(max(generation) AS VARCHAR), 6, '0') AS key_id FROM alive GROUP BY subject", "alive")
def current_generation(spark, d):
    return keystore.current_keys(V.key_generations(spark, d), _stones(spark, d))


@query("SELECT h.stream_id AS subject, coalesce(string_agg(lpad(CAST(generation AS VARCHAR), 6, '0'), ',' ORDER BY generation), '') AS key_ids FROM hd h LEFT JOIN alive a ON a.subject = h.stream_id GROUP BY h.stream_id", "hd", "alive")
def keyring(spark, d):
    subjects = V.stream_events(spark, d).select(F.col("stream_id").alias("subject")).distinct()
    return keystore.keyrings(V.key_generations(spark, d), _stones(spark, d), subjects).select("subject", F.array_join("key_ids", ",").alias("key_ids"))


@query("SELECT h.stream_id AS subject, coalesce(max(generation) + 1, 0) AS generation FROM hd h LEFT JOIN kg ON kg.subject = h.stream_id GROUP BY h.stream_id", "hd", "kg")
def rotate_keys(spark, d):
    subjects = V.stream_events(spark, d).select(F.col("stream_id").alias("subject")).distinct()
    return keystore.next_generation(V.key_generations(spark, d), subjects)


WANTED = "(SELECT stream_id AS subject, version, version % 3 AS generation FROM se WHERE type = 'purchase')"


@query(f"SELECT subject, version, generation FROM {WANTED} w WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.subject = w.subject AND a.generation = w.generation)", "se", "alive")
def undeliverable_keys(spark, d):
    wanted = V.stream_events(spark, d).where("type = 'purchase'").select(F.col("stream_id").alias("subject"), "version", (F.col("version") % 3).alias("generation"))
    return keystore.undeliverable(wanted, V.key_generations(spark, d), _stones(spark, d)).select("subject", "version", "generation")


MISSING = "(SELECT subject, generation FROM kg UNION SELECT subject, generation + 100 FROM kg)"


@query(f"SELECT w.subject, w.generation, CASE WHEN t.status IN ('pending', 'committing') THEN 'erased' WHEN k.subject IS NOT NULL THEN 'ok' ELSE 'missing' END AS status FROM {MISSING} w LEFT JOIN kg k USING (subject, generation) LEFT JOIN tomb t ON t.subject = w.subject", "kg", "tomb")
def key_lookup(spark, d):
    """Every key, and as many that were never minted."""
    g = V.key_generations(spark, d)
    wanted = g.select("subject", "generation").unionByName(g.select("subject", (F.col("generation") + 100).alias("generation")))
    return keystore.lookup_status(wanted, g, _stones(spark, d)).select("subject", "generation", "status")


@query(
    "SELECT subject, generation, lpad(CAST(generation AS VARCHAR), 6, '0') AS key_id, outcome, CASE WHEN outcome = 'minted' THEN CASE WHEN generation = 0 THEN 'KeyCreated' ELSE 'KeyRotated' END END AS audit, gone AND NOT was AND NOT there AS stray FROM (SELECT w.*, CASE WHEN was THEN 'erased' WHEN there THEN 'lost-race' WHEN gone THEN 'erased' ELSE 'minted' END AS outcome FROM (SELECT w.subject, w.generation, coalesce(t.status IN ('pending', 'committing'), false) AS gone, coalesce(t.status IN ('pending', 'committing'), false) AND length(w.subject) % 2 = 0 AS was, k.subject IS NOT NULL AS there FROM (SELECT h.stream_id AS subject, greatest(coalesce(max(generation) + 1, 0) - CAST(length(h.stream_id) % 2 AS BIGINT) * CAST(max(head) % 2 AS BIGINT), 0) AS generation FROM hd h LEFT JOIN kg ON kg.subject = h.stream_id GROUP BY h.stream_id) w LEFT JOIN tomb t USING (subject) LEFT JOIN kg k ON k.subject = w.subject AND k.generation = w.generation) w)",
    "hd", "kg", "tomb",
)
def mint_keys(spark, d):
    """Some minters know a generation that another one took; some tombstones appear between the reads."""
    g, stones = V.key_generations(spark, d), _stones(spark, d)
    late = F.length("subject") % 2 * (F.col("head") % 2)
    heads = replay.heads(V.stream_events(spark, d)).select(F.col("stream_id").alias("subject"), F.col("version").alias("head"))
    wanted = keystore.next_generation(g, heads).join(heads, "subject").select("subject", F.greatest(F.col("generation") - late, F.lit(0)).alias("generation"))
    return keystore.mint(wanted, g, stones.where("length(subject) % 2 = 0"), stones)


@query("SELECT a.subject, lpad(CAST(generation AS VARCHAR), 6, '0') AS key_id, TIMESTAMP '2024-01-20 00:05:00' AS expires_at FROM alive a", "alive")
def keyring_entries(spark, d):
    return keystore.keyring_entries(V.key_generations(spark, d), _stones(spark, d), F.expr(NOW), 300).select("subject", "key_id", "expires_at")


@query(
    f"SELECT w.subject, w.version, CASE WHEN version % 2 = 0 AND (ring OR TIMESTAMP '2024-01-20 00:00:00' < fetched_at + INTERVAL 30 SECOND) THEN 'cached' ELSE 'fetch' END AS action, there AS deliverable FROM (SELECT w.*, TIMESTAMP '2024-01-20 00:00:00' - version * INTERVAL 1 SECOND AS fetched_at, EXISTS (SELECT 1 FROM alive a WHERE a.subject = w.subject) AS ring, EXISTS (SELECT 1 FROM alive a WHERE a.subject = w.subject AND a.generation = w.generation) AS there FROM {WANTED} w) w",
    "se", "alive",
)
def keyring_fetches(spark, d):
    """Clients that fetched a ring some seconds ago and know every other key id."""
    wanted = V.stream_events(spark, d).where("type = 'purchase'").select(F.col("stream_id").alias("subject"), "version", K.generation_id(F.col("version") % 3).alias("key_id"))
    wanted = wanted.withColumns({"fetched_at": F.expr(NOW) - F.make_dt_interval(secs=F.col("version")), "known": F.col("version") % 2 == 0})
    rings = keystore.keyring_entries(V.key_generations(spark, d), _stones(spark, d), F.expr(NOW), 300)
    return keystore.fetches(wanted, rings, F.expr(NOW)).select("subject", "version", "action", "deliverable")


@query("SELECT subject, position FROM oi", "oi")
def open_intents(spark, d):
    return shred.open_intents(_audit(spark, d)).select("subject", "position")


@query("SELECT subject, max(position) AS position FROM oi GROUP BY subject", "oi")
def newest_intent(spark, d):
    return shred.newest_intents(shred.open_intents(_audit(spark, d))).select("subject", "position")


NOW = "cast('2024-01-20 00:00:00' as timestamp_ntz)"


def _swept(spark, d):
    audit = _audit(spark, d)
    return audit, shred.sweep(audit, shred.tombstones(audit), F.expr(NOW), "14 DAY")


def _committed(spark, d):
    """Some tombstones move between the sweep's reading and its writing."""
    audit, swept = _swept(spark, d)
    now = F.when(F.col("position") % 3 == 0, "pending").when(F.col("position") % 3 == 1, "committing").otherwise("cancelled")
    return audit, shred.commit_point(swept, swept.select("subject", now.alias("status"), (F.length("subject") % 4 == 0).alias("etag_moved")))


@query("SELECT subject, position, outcome FROM sw", "sw")
def sweep_due(spark, d):
    return _swept(spark, d)[1]


@query("SELECT subject, position, outcome FROM cp", "cp")
def sweep_commit_point(spark, d):
    return _committed(spark, d)[1].select("subject", "position", "outcome")


RECONCILED = "SELECT subject FROM st JOIN (SELECT DISTINCT subject, intent FROM au WHERE type = 'ShredCancelled' AND position > intent) c USING (subject, intent) WHERE status = 'pending' AND subject NOT IN (SELECT subject FROM oi)"


@query(f"SELECT subject, CASE outcome WHEN 'committed' THEN 'hardDeleted' ELSE 'open' END AS outcome FROM cp WHERE outcome IN ('committed', 'waiting') UNION ALL SELECT subject, 'reconciled' FROM ({RECONCILED})", "cp", "st", "au", "oi")
def sweep_report(spark, d):
    audit, committed = _committed(spark, d)
    return shred.report(committed, shred.reconcile(shred.tombstones(audit), audit))


@query("SELECT subject, generation FROM kg WHERE subject NOT IN (SELECT subject FROM cp WHERE outcome = 'committed')", "kg", "cp")
def sweep_hard_delete(spark, d):
    return shred.hard_delete(V.key_generations(spark, d), _committed(spark, d)[1]).select("subject", "generation")


@query("SELECT count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT position) AS places, min(position) AS low, max(position) AS high FROM (SELECT subject, (SELECT max(position) + 1 FROM au) + row_number() OVER (ORDER BY subject) - 1 AS position FROM cp WHERE outcome = 'committed')", "cp", "au")
def sweep_completions(spark, d):
    """Audit entries of the deleted: one each, on dense places after the log's end."""
    audit, committed = _committed(spark, d)
    start = F.lit(audit.agg(F.coalesce(F.max("position") + 1, F.lit(0))).first()[0])
    done = shred.completions(committed, start)
    return done.agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("position").alias("places"), F.min("position").alias("low"), F.max("position").alias("high"))


@query("SELECT subject, position, (SELECT max(position) + 1 FROM au) AS from_version FROM oi WHERE subject NOT IN (SELECT subject FROM cp WHERE outcome = 'committed')", "oi", "cp", "au")
def sweep_checkpoint(spark, d):
    audit, committed = _committed(spark, d)
    return shred.checkpoint(audit, committed)


@query("SELECT subject, position FROM oi", "oi")
def sweep_resumed(spark, d):
    """Open intents from a checkpoint taken in the middle of the log and the entries after it."""
    audit = _audit(spark, d)
    early = audit.where("ts < '2024-01-12'")
    return shred.resumed(shred.checkpoint(early, early.select("subject", F.lit("waiting").alias("outcome"))), audit)


@query("SELECT subject, position + 1000000000 AS intent FROM (SELECT stream_id AS subject, row_number() OVER (ORDER BY stream_id) - 1 AS position FROM hd) WHERE subject NOT IN (SELECT subject FROM tomb WHERE status = 'committing')", "hd", "tomb")
def shred_requests(spark, d):
    """A request for every stream: pending tombstones take the new intent, committed ones stay."""
    audit = _audit(spark, d)
    subjects = replay.heads(V.stream_events(spark, d)).select(F.col("stream_id").alias("subject"), (F.row_number().over(W.orderBy("stream_id")) - 1).alias("n"), F.expr(NOW).alias("ts"))
    stones = shred.tombstones(shred.requested(audit, subjects, F.lit(1_000_000_000)))
    return stones.where("status = 'pending'").select("subject", "intent")


@query("SELECT subject, arg_max(status, n) AS status, max(intent) FILTER (n = top) AS intent, max(since) FILTER (n = top) AS requested_at FROM (SELECT *, max(n) OVER (PARTITION BY subject) AS top FROM ts0) GROUP BY subject", "ts0")
def tombstone_state(spark, d):
    return _stones(spark, d).drop("since")


@query("SELECT subject, position, outcome FROM ts0 WHERE outcome IS NOT NULL", "ts0")
def cancel_outcomes(spark, d):
    return shred.cancel_outcomes(_audit(spark, d))


@query(
    "SELECT subject, stamp AS intent FROM (SELECT subject, max(position) FILTER (type = 'ShredRequested') AS stamp, min(position) FILTER (type = 'ShredRequested') AS low, max(position) FILTER (type = 'ShredCompleted') AS done FROM au GROUP BY subject) s WHERE stamp IS NOT NULL AND (done IS NULL OR done < low) AND EXISTS (SELECT 1 FROM au c WHERE c.type = 'ShredCancelled' AND c.subject = s.subject AND c.intent = stamp AND c.position > stamp) AND NOT EXISTS (SELECT 1 FROM oi WHERE oi.subject = s.subject)",
    "au", "oi",
)
def reconcile_cancellations(spark, d):
    """As if every cancellation had crashed between its audit entry and the tombstone."""
    audit = _audit(spark, d)
    return shred.reconcile(shred.tombstones(audit.where("type <> 'ShredCancelled'")), audit)


@query("SELECT subject, position, type, row_number() OVER (PARTITION BY subject ORDER BY position) AS n FROM au", "au")
def audit_timeline(spark, d):
    return shred.timeline(_audit(spark, d)).select("subject", "position", "type", "n")


# -- integrity -------------------------------------------------------------------------------


@query("SELECT stream_id, count(*) AS n, min(version) = 0 AND max(version) + 1 = count(*) AND count(DISTINCT version) = count(*) AS dense FROM (SELECT stream_id, version FROM se WHERE event_id % 97 <> 0) GROUP BY stream_id", "se")
def density_check(spark, d):
    """With some events taken away, so that there is something to find."""
    return integrity.density(V.stream_events(spark, d).where("event_id % 97 <> 0"))


@query("SELECT * FROM (SELECT stream_id, CAST(event_id - event_id % 2 * (event_id % 3) AS VARCHAR) AS id, count(*) AS n FROM se GROUP BY ALL) WHERE n > 1", "se")
def duplicate_ids(spark, d):
    log = V.stream_events(spark, d).withColumn("id", (F.col("event_id") - F.col("event_id") % 2 * (F.col("event_id") % 3)).cast("string"))
    return integrity.duplicate_ids(log)


OUTCOME = "CASE base_version % 3 WHEN 0 THEN 'committed' WHEN 1 THEN 'rejected' ELSE 'indefinite' END"
THERE = "(base_version % 3 = 0 AND event_id % 41 <> 0) OR (base_version % 3 = 1 AND event_id % 43 = 0) OR (base_version % 3 = 2 AND event_id % 5 <> 0)"


@query(
    f"SELECT attempt_id, outcome, CASE WHEN outcome = 'committed' AND there < n THEN 'missing' WHEN outcome = 'rejected' AND there > 0 THEN 'phantom' WHEN outcome = 'indefinite' AND there > 0 AND there < n THEN 'torn' ELSE 'ok' END AS verdict FROM (SELECT base_version || '@' || stream_id AS attempt_id, {OUTCOME} AS outcome, count(*) AS n, count(*) FILTER ({THERE}) AS there FROM ce GROUP BY stream_id, base_version)",
    "ce",
)
def outcome_check(spark, d):
    e = V.commit_events(spark, d)
    tried = e.select(F.concat_ws("@", "base_version", "stream_id").alias("attempt_id"), "stream_id", "id", F.expr(OUTCOME).alias("outcome"))
    return integrity.outcomes(tried, e.where(THERE))


@query("SELECT stream_id, version, id FROM se WHERE event_id % 50 = 0", "se")
def unknown_ids(spark, d):
    e = V.stream_events(spark, d)
    return integrity.unknown_ids(e, e.where("event_id % 50 <> 0")).select("stream_id", "version", "id")


KNOWN = "CASE base_version % 5 WHEN 3 THEN 'indefinite' WHEN 4 THEN 'inFlight' ELSE 'committed' END"


@query(
    f"SELECT h.stream_id, 40 AS at, h.head - 3 * (length(h.stream_id) % 2) AS head, least, most, h.head - 3 * (length(h.stream_id) % 2) BETWEEN least AND most AS honest FROM hd h JOIN (SELECT stream_id, coalesce(max(last_version) FILTER (base_version <= 40 AND outcome = 'committed'), -1) AS least, coalesce(max(last_version) FILTER (outcome = 'committed'), -1) + CAST(coalesce(sum(commit_size) FILTER (outcome <> 'committed'), 0) AS BIGINT) AS most FROM (SELECT *, {KNOWN} AS outcome FROM cm) GROUP BY stream_id) b USING (stream_id)",
    "hd", "cm",
)
def forged_head_bounds(spark, d):
    """Some commits are in doubt or in flight."""
    e = V.commit_events(spark, d)
    commits = layout.commit_table(e).select("stream_id", F.col("base_version").alias("done_at"), F.col("last_version").alias("last"), F.col("commit_size").alias("size"), F.expr(KNOWN).alias("outcome"))
    reads = replay.heads(e).select("stream_id", F.lit(40).alias("at"), (F.col("version") - 3 * (F.length("stream_id") % 2)).alias("head"))
    return integrity.head_bounds(reads, commits)


@query("SELECT stream_id, version FROM ce WHERE event_id % 61 = 0 AND top >= (base_version // 10) * 10 + 10 OR event_id % 59 = 0 AND top < (base_version // 10) * 10 + 10".replace("FROM ce", "FROM (SELECT *, max(base_version) OVER (PARTITION BY stream_id) AS top FROM ce)"), "ce")
def storage_invariant_compacted(spark, d):
    """What can be read is the chunks and the tail of buckets without one; each has lost something."""
    e = stored(spark, "commit-events", V.commit_events(spark, d))
    buckets = layout.sealed_buckets(layout.commit_table(e), 10)
    chunks = buckets.where("sealed").select("stream_id", F.col("bucket").alias("chunk_base"))
    chunked = layout.compact(e, buckets, 10).where("event_id % 61 <> 0")
    return integrity.storage_loss(e, layout.compacted_read(chunked, e.where("event_id % 59 <> 0"), 10, chunks=chunks)).select("stream_id", "version")


@query("SELECT stream_id, version FROM se WHERE event_id % 61 = 0", "se")
def storage_invariant(spark, d):
    e = V.stream_events(spark, d).select("stream_id", "version", "event_id")
    return integrity.storage_loss(e, e.where("event_id % 61 <> 0")).select("stream_id", "version")


@query("SELECT stream_id, version, id FROM se", "se")
def manifest_append_read(spark, d):
    """Attempts admitted, written, published by a create-only entry and read from the snapshot."""
    from ..sources.manifest import Log

    log = Log(spark, shared(spark, "log"))
    e = V.stream_events(spark, d).select("stream_id", "version", "id")
    given = e.select("stream_id", F.col("version").alias("arrival"), F.col("id").cast("long").alias("attempt_id"), F.lit("any").alias("expected_kind"), F.lit(None).cast("long").alias("expected_version"), F.lit(1).alias("n_events"))

    def build(decided: DataFrame) -> DataFrame:
        return decided.where("ok").select("stream_id", F.col("base").alias("version"), F.col("attempt_id").cast("string").alias("id"))

    schema = "stream_id string, version long, id string"
    log.append(given, build, schema)
    return log.read(schema)


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
