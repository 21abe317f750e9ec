"""Event streams derived from the generated tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.layout import commits_of


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stream_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream_id"), "user_id", "event_id", "ts", "value", F.col("event_type").alias("type"), F.col("props").alias("data"))
    version = F.row_number().over(W.partitionBy("stream_id").orderBy("ts", "event_id")).cast("long") - 1
    return e.withColumn("version", version).withColumn("id", F.col("event_id").cast("string"))


def commit_events(spark: SparkSession, d: str) -> DataFrame:
    return commits_of(stream_events(spark, d), (F.col("version") == 0) | (F.col("event_id") % 3 != 0))


def conv_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("stream_id"), F.col("turn").alias("version"), F.col("role").alias("subject"), "text")


def audit_events(spark: SparkSession, d: str) -> DataFrame:
    """Positions are counted by day and then within the day, so no task orders the whole stream."""
    e = table(spark, d, "events")
    kind = (
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "ShredRequested")
        .when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), "ShredCancelled")
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 9 == 0), "ShredCompleted")
    )
    e = e.select(kind.alias("type"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("subject"), "ts", "event_id", F.to_date("ts").alias("day")).where("type IS NOT NULL")
    # one row for each day
    before = F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    days = e.groupBy("day").agg(F.count("*").alias("n")).select("day", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("day").orderBy("ts", "event_id"))
    e = e.withColumn("within", within).join(days, "day").withColumn("position", (F.col("before") + F.col("within") - 1).cast("long"))
    asked = F.last(F.when(F.col("type") == "ShredRequested", F.col("position")), ignorenulls=True).over(W.partitionBy("subject").orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    e = e.withColumn("intent", F.when(F.col("type") == "ShredCancelled", asked))
    return e.where("type <> 'ShredCancelled' OR intent IS NOT NULL").select("position", "type", "subject", "intent", "ts")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e, k = stream_events(spark, d), F.col("event_id") % 4
    kind = F.when(k == 1, "noStream").when(k == 2, "version").otherwise("any")
    return e.select("stream_id", (F.col("version") + 1).alias("arrival"), F.col("event_id").alias("attempt_id"), kind.alias("expected_kind"), F.when(k == 2, F.col("event_id") % 10).alias("expected_version"), (1 + F.col("event_id") % 3).alias("n_events"))


def key_generations(spark: SparkSession, d: str) -> DataFrame:
    """A generation for each sign-up of a user, the first included; key bytes from its name."""
    e = stream_events(spark, d).where("type = 'signup'").select("stream_id", "version")
    gen = F.row_number().over(W.partitionBy("stream_id").orderBy("version")).cast("long") - 1
    e = e.withColumn("generation", gen)
    return e.select(F.col("stream_id").alias("subject"), "generation", F.unhex(F.sha2(F.concat_ws("/", F.lit("k"), "stream_id", "generation"), 256)).alias("key"))


SQL = {
    "se": """SELECT 'user-' || user_id AS stream_id, user_id, event_id, ts, value, event_type AS type, props AS data,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS version, CAST(event_id AS VARCHAR) AS id FROM events""",
    "ce": """SELECT *, min(version) OVER (PARTITION BY stream_id, commit_seq) AS base_version FROM (
  SELECT *, CAST(sum(CASE WHEN version = 0 OR event_id % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY version) - 1 AS BIGINT) AS commit_seq FROM se)""",
    "cm": """SELECT stream_id, commit_seq, base_version, count(*) AS commit_size, max(version) AS last_version FROM ce GROUP BY ALL""",
    "hd": "SELECT stream_id, max(version) AS head FROM se GROUP BY stream_id",
    "conv": "SELECT 'conv-' || conv_id AS stream_id, turn AS version, role AS subject, text FROM conversations",
    "au0": """SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS position, type, subject, ts FROM (SELECT ts, event_id, 'user-' || user_id AS subject,
  CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'ShredRequested' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'ShredCancelled'
  WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN 'ShredCompleted' END AS type FROM events) WHERE type IS NOT NULL""",
    "au": """SELECT * FROM (SELECT position, type, subject, CASE WHEN type = 'ShredCancelled' THEN last_value(CASE WHEN type = 'ShredRequested' THEN position END IGNORE NULLS)
  OVER (PARTITION BY subject ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS intent, ts FROM au0) WHERE type <> 'ShredCancelled' OR intent IS NOT NULL""",
    "oi": """SELECT subject, position, ts FROM au r WHERE type = 'ShredRequested'
  AND NOT EXISTS (SELECT 1 FROM au c WHERE c.type = 'ShredCancelled' AND c.subject = r.subject AND c.intent = r.position AND c.position > r.position)
  AND NOT EXISTS (SELECT 1 FROM au c WHERE c.type = 'ShredCompleted' AND c.subject = r.subject AND c.position > r.position)""",
    "att": """SELECT stream_id, version + 1 AS arrival, event_id AS attempt_id, CASE event_id % 4 WHEN 1 THEN 'noStream' WHEN 2 THEN 'version' ELSE 'any' END AS kind,
  event_id % 10 AS want, 1 + event_id % 3 AS n FROM se""",
    "ad": """SELECT stream_id, arrival, attempt_id, ok, CASE WHEN ok THEN h + 1 END AS base, CASE WHEN ok THEN h + n ELSE h END AS head FROM (
    SELECT *, -1 AS h, kind IN ('any', 'noStream') AS ok FROM att WHERE arrival = 1)
  UNION ALL SELECT stream_id, arrival, attempt_id, ok, CASE WHEN ok THEN h + 1 END, CASE WHEN ok THEN h + n ELSE h END FROM (
    SELECT a.*, p.head AS h, (a.kind = 'any' OR (a.kind = 'noStream' AND p.head < 0) OR (a.kind = 'version' AND p.head >= 0 AND p.head = a.want)) AS ok
    FROM ad p JOIN att a ON a.stream_id = p.stream_id AND a.arrival = p.arrival + 1)""",
    "sq": "SELECT *, row_number() OVER (PARTITION BY subject ORDER BY position) AS n FROM au",
    "ts0": """SELECT subject, 0 AS n, 'none' AS status, CAST(NULL AS BIGINT) AS intent, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT subject FROM au)
  UNION ALL SELECT subject, n, CASE WHEN type = 'ShredRequested' AND status IN ('none', 'cancelled') THEN 'pending' WHEN oc = 'cancelled' THEN 'cancelled'
    WHEN type = 'ShredCompleted' AND status = 'pending' THEN 'committing' ELSE status END,
    CASE WHEN type = 'ShredRequested' AND status IN ('none', 'cancelled') THEN position WHEN type = 'ShredRequested' AND status = 'pending' THEN greatest(stamp, position) ELSE stamp END,
    CASE WHEN type = 'ShredRequested' AND status IN ('none', 'cancelled') THEN position ELSE since END, position, oc
  FROM (SELECT q.subject, q.n, q.type, q.position, p.status, p.intent AS stamp, p.since, CASE WHEN q.type = 'ShredCancelled' THEN
    CASE WHEN p.status IN ('none', 'cancelled') THEN 'already-cancelled' WHEN p.status = 'committing' THEN 'lost-to-commit' WHEN p.intent <> q.intent THEN 'superseded' ELSE 'cancelled' END END AS oc
    FROM ts0 p JOIN sq q ON q.subject = p.subject AND q.n = p.n + 1)""",
    "tomb": "SELECT subject, arg_max(status, n) AS status FROM ts0 GROUP BY subject",
    "st": "SELECT t.*, a.ts AS since_ts FROM (SELECT subject, status, intent, since FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC) AS r FROM ts0) WHERE r = 1) t LEFT JOIN au a ON a.position = t.since",
    "sw": """SELECT n.subject, n.position, CASE status WHEN 'committing' THEN 'committed' WHEN 'pending' THEN CASE WHEN since_ts + INTERVAL 14 DAY <= TIMESTAMP '2024-01-20 00:00:00' THEN 'due' ELSE 'waiting' END END AS outcome
  FROM (SELECT subject, max(position) AS position FROM oi GROUP BY subject) n JOIN st USING (subject) WHERE status IN ('pending', 'committing')""",
    "cp": """SELECT subject, position, CASE WHEN outcome <> 'due' THEN outcome WHEN length(subject) % 4 <> 0 THEN 'committed'
  ELSE CASE position % 3 WHEN 0 THEN 'waiting' WHEN 1 THEN 'committed' ELSE 'closed' END END AS outcome FROM sw""",
    "kg": "SELECT stream_id AS subject, row_number() OVER (PARTITION BY stream_id ORDER BY version) - 1 AS generation FROM se WHERE type = 'signup'",
    "alive": "SELECT * FROM kg WHERE subject NOT IN (SELECT subject FROM tomb WHERE status IN ('pending', 'committing'))",
}
NEEDS = {"ce": ["se"], "cm": ["ce"], "hd": ["se"], "au": ["au0"], "oi": ["au"], "att": ["se"], "ad": ["att"], "sq": ["au"], "ts0": ["sq"], "tomb": ["ts0"], "st": ["ts0", "au"], "sw": ["oi", "st"], "cp": ["sw"], "kg": ["se"], "alive": ["kg", "tomb"]}


def sql(body: str, *views: str) -> str:
    """``body`` under the named views and those that they need."""
    order: list[str] = []

    def add(v: str) -> None:
        for w in NEEDS.get(v, []):
            add(w)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return body
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v]})" for v in order) + " " + body
