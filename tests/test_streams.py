"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from strandbook.functions import keys as K
from strandbook.operators import admission, crypto, feed, keystore, layout, replay, shred, transform
from strandbook.sources.manifest import Conflict, Log


def log_of(spark, n, stream="s"):
    return spark.range(n).select(F.lit(stream).alias("stream_id"), F.col("id").alias("version"), F.col("id").cast("string").alias("id"), F.lit("E").alias("type"), F.col("id").cast("string").alias("data"))


@pytest.mark.parametrize(("start", "size", "want"), [(372, 100, 300), (7, 3, 6), (-5, 100, 0), (float("nan"), 100, 0), (float("inf"), 100, 0)])
def test_canonical_from(spark, start, size, want):
    assert spark.range(1).select(K.canonical_from(F.lit(start), size)).first()[0] == want


def test_pages(spark):
    asked = spark.createDataFrame([("s", 3), ("s", 7), ("absent", 0)], "stream_id string, requested long")
    got = {(r.stream_id, r.requested): r for r in feed.page_requests(log_of(spark, 10), asked, 3).collect()}
    r = got["s", 3]
    assert (r.page_from, r.page_to, r.complete, r.next, r.prev, r.redirect) == (3, 6, True, 6, 0, False)
    assert (got["s", 7].page_from, got["s", 7].page_to, got["s", 7].prev) == (6, 9, 3)
    assert (got["absent", 0].n_events, got["absent", 0].complete) == (0, False)
    assert [p.complete for p in feed.pages(log_of(spark, 3), 3).collect()] == [False]
    assert sorted((p.page_from, p.complete) for p in feed.pages(log_of(spark, 4), 3).collect()) == [(0, True), (3, False)]


def test_head(spark):
    asked = spark.createDataFrame([("s",), ("absent",)], "stream_id string")
    got = {r.stream_id: (r.version, r["head"], r.etag) for r in replay.head_resource(log_of(spark, 8), asked, 3).collect()}
    assert got == {"s": (7, 6, '"v7"'), "absent": (None, 0, '"empty"')}


@pytest.mark.parametrize(("n", "per", "want"), [(6, 4, [0, 4]), (5, 3, [0, 3]), (5, 2, [0, 2, 4])])
def test_chunk_bases(spark, n, per, want):
    commits = layout.commit_table(layout.commits_of(log_of(spark, n), F.lit(True)))
    assert sorted(r.chunk_base for r in layout.tail_chunks(commits, per).collect()) == want
    sized = commits.withColumn("bytes", F.lit(1).cast("long"))
    assert sorted({r.chunk_base for r in layout.roll_by_size(sized, "bytes", per, 10**6).collect()}) == want


def test_compaction(spark):
    commits = layout.commit_table(layout.commits_of(log_of(spark, 8), F.lit(True)))
    assert sorted(r.bucket for r in layout.sealed_buckets(commits, 2).where("sealed").collect()) == [0, 2, 4]
    straddle = layout.commit_table(layout.commits_of(log_of(spark, 5), F.col("version") != 2))
    got = layout.sealed_buckets(straddle, 2).where("sealed").select("bucket", "first_base", "last_base").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1), (2, 3, 3)]


def test_admission_and_heads(spark):
    rows = [("s", 1, 1, "version", 0, 1), ("s", 2, 2, "noStream", None, 2), ("s", 3, 3, "noStream", None, 1), ("s", 4, 4, "version", 1, 1), ("s", 5, 5, "any", None, 3)]
    tries = spark.createDataFrame(rows, "stream_id string, arrival long, attempt_id long, expected_kind string, expected_version long, n_events long")
    want = [(1, False, None), (2, True, 0), (3, False, None), (4, True, 2), (5, True, 3)]
    got = admission.admit(tries).orderBy("arrival").collect()
    assert [(r.attempt_id, r.ok, r.base) for r in got] == want
    heads = spark.createDataFrame([("s", 0)], "stream_id string, version long")
    assert [r.ok for r in admission.admit(tries, heads).orderBy("arrival").collect()] == [True, False, False, True, True]
    assert admission.admit(tries.limit(0)).count() == 0


def test_fold(spark):
    got = transform.fold_by_aggregates(log_of(spark, 5), n=F.sum(F.col("data").cast("long"))).first()
    assert (got.version, got.n) == (4, 10)


def test_altered_payload_fails_and_missing_key_is_shredded(spark):
    log = log_of(spark, 2)
    keys = spark.createDataFrame([("s", "000000", bytearray(range(32)))], "stream_id string, key_id string, key binary")
    secret = crypto.encrypt_payloads(log, keys)
    assert [r.status for r in crypto.decrypt_payloads(secret, keys.limit(0)).collect()] == ["shredded", "shredded"]
    altered = secret.withColumn("data", F.base64(F.concat(F.unbase64("data"), F.lit("x").cast("binary"))))
    assert {r.status for r in crypto.decrypt_payloads(altered, keys, strict=False).select("status").collect()} == {"corrupt"}
    with pytest.raises(Exception, match="authentication"):
        crypto.decrypt_payloads(altered, keys).collect()


AUDIT = "position long, type string, subject string, intent long, ts timestamp_ntz"


def audit_of(spark, *rows):
    """(type, subject, intent, day of January) in the order of positions."""
    from datetime import datetime

    return spark.createDataFrame([(i, t, s, n, datetime(2024, 1, day)) for i, (t, s, n, day) in enumerate(rows)], AUDIT)


def test_tombstones(spark):
    asked, cancelled, done = "ShredRequested", "ShredCancelled", "ShredCompleted"
    audit = audit_of(spark, (asked, "a", None, 1), (asked, "a", None, 2), (cancelled, "a", 0, 3), (cancelled, "a", 1, 4), (cancelled, "a", 1, 5), (asked, "a", None, 6), (done, "a", None, 7), (cancelled, "a", 5, 8))
    assert [r.outcome for r in shred.cancel_outcomes(audit).orderBy("position").collect()] == ["superseded", "cancelled", "already-cancelled", "lost-to-commit"]
    assert tuple(shred.tombstones(audit).drop("since").first()) == ("a", "committing", 5, 5)
    assert shred.tombstones(audit.limit(0)).count() == 0


def test_waiting_period_runs_from_the_first_request(spark):
    asked, cancelled = "ShredRequested", "ShredCancelled"
    audit = audit_of(spark, (asked, "a", None, 1), (asked, "a", None, 13), (asked, "b", None, 1), (cancelled, "b", 2, 2), (asked, "b", None, 13), (asked, "c", None, 10))
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    got = {r.subject: (r.position, r.outcome) for r in shred.sweep(audit, shred.tombstones(audit), now, "14 DAY").collect()}
    assert got == {"a": (1, "due"), "b": (4, "waiting"), "c": (5, "waiting")}


def test_lookup_fails_loudly_on_keys_never_minted(spark):
    keys = spark.createDataFrame([("a", 0, bytearray(b"k"))], "subject string, generation long, key binary")
    stones = spark.createDataFrame([("a", "cancelled"), ("b", "pending")], "subject string, status string")
    ask = lambda *rows: spark.createDataFrame(rows, "subject string, generation long")
    assert {(r.subject, r.key is not None) for r in keystore.lookup(ask(("a", 0), ("b", 0)), keys, stones).collect()} == {("a", True), ("b", False)}
    with pytest.raises(Exception, match="never minted"):
        keystore.lookup(ask(("a", 1)), keys, stones).collect()


def test_mint_against_tombstones(spark):
    wanted = spark.createDataFrame([("old", 0), ("late", 0), ("raced", 0), ("fresh", 0), ("next", 3)], "subject string, generation long")
    keys = spark.createDataFrame([("raced", 0), ("next", 2)], "subject string, generation long")
    before = spark.createDataFrame([("old", "pending"), ("fresh", "cancelled")], "subject string, status string")
    after = before.unionByName(spark.createDataFrame([("late", "pending")], "subject string, status string"))
    got = {r.subject: (r.outcome, r.stray, r.audit) for r in keystore.mint(wanted, keys, before, after).collect()}
    assert got == {"old": ("erased", False, None), "late": ("erased", True, None), "raced": ("lost-race", False, None), "fresh": ("minted", False, "KeyCreated"), "next": ("minted", False, "KeyRotated")}


def test_manifest_conflict_and_snapshot(spark, tmp_path):
    schema = "stream_id string, version long"
    log, other = Log(spark, str(tmp_path / "log")), Log(spark, str(tmp_path / "log"))
    assert log.version() == -1 and log.read(schema).count() == 0
    one = spark.createDataFrame([("s", 0)], schema)
    log.publish(0, log.stage(one))
    with pytest.raises(Conflict):
        other.publish(0, other.stage(one))
    assert other.read(schema).count() == 1
    assert other.vacuum() == 0  # the loser's folder is young: it may be published yet
    assert other.vacuum(0) == 1 and log.read(schema).count() == 1
    log.publish(1, log.stage(spark.createDataFrame([("s", 1)], schema)))
    assert log.checkpoint() == 1
    log.publish(2, log.stage(spark.createDataFrame([("s", 2)], schema)))
    assert [log.read(schema, v).count() for v in (-1, 0, 1, 2)] == [0, 1, 2, 3] and other.vacuum(0) == 0


def test_a_losing_writer_decides_again(spark, tmp_path):
    schema = "stream_id string, version long"
    log, other = Log(spark, str(tmp_path / "log")), Log(spark, str(tmp_path / "log"))
    tries = spark.createDataFrame([("s", 0, 1, "noStream", None, 1), ("t", 0, 2, "noStream", None, 2)], TRIES)
    raced = []

    def build(decided):
        if not raced:  # another writer publishes first
            raced.append(1)
            other.publish(0, other.stage(spark.createDataFrame([("s", 0)], schema)))
        n = F.when(F.col("attempt_id") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return decided.where("ok").select("stream_id", F.explode(n).alias("i"), "base").select("stream_id", (F.col("base") + F.col("i")).cast("long").alias("version"))

    decided = {r.stream_id: r.ok for r in log.append(tries, build, schema).collect()}
    assert decided == {"s": False, "t": True} and log.version() == 1
    assert sorted(map(tuple, log.read(schema).collect())) == [("s", 0), ("t", 0), ("t", 1)]


TRIES = "stream_id string, arrival long, attempt_id long, expected_kind string, expected_version long, n_events long"


def test_idempotent_append_outcomes(spark):
    log = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c")], "stream_id string, version long, id string")
    tries = [(1, "s", 1, "version", 2), (2, "s", 2, "version", 0), (3, "s", 3, "version", 0), (4, "s", 4, "any", None), (5, "s", 5, "version", 2), (6, "s", 6, "version", 2), (7, "new", 1, "noStream", None), (8, "s", 7, "noStream", None), (9, "s", 8, "version", 1)]
    events = [(1, 0, "d"), (1, 1, "e"), (2, 0, "b"), (2, 1, "c"), (3, 0, "c"), (3, 1, "b"), (4, 0, "x"), (5, 0, None), (7, 0, "n"), (8, 0, "a"), (9, 0, "c"), (9, 1, "z")]
    got = admission.idempotent_append(spark.createDataFrame(tries, "attempt_id long, stream_id string, arrival long, expected_kind string, expected_version long"), spark.createDataFrame(events, "attempt_id long, pos long, id string"), log)
    assert {r.attempt_id: (r.outcome, r.base, r.next_expected) for r in got.collect()} == {
        1: ("appended", 3, 4), 2: ("alreadyCommitted", 1, 2), 3: ("conflict", None, None), 4: ("refused", None, None), 5: ("refused", None, None),
        6: ("refused", None, None), 7: ("appended", 0, 0), 8: ("alreadyCommitted", 0, 0), 9: ("conflict", None, None),
    }


def test_known_ciphertext_and_header(spark):
    """A payload made by another implementation with a fixed nonce opens; the header tells how."""
    import base64
    import gzip
    import json

    jvm, key, nonce = spark._jvm, bytes(range(32)), bytes(range(12))

    def sealed(plain: bytes, aad: str) -> str:
        cipher = jvm.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
        cipher.init(1, jvm.javax.crypto.spec.SecretKeySpec(bytearray(key), "AES"), jvm.javax.crypto.spec.GCMParameterSpec(128, bytearray(nonce)))
        cipher.updateAAD(bytearray(aad.encode()))
        return base64.b64encode(nonce + bytes(cipher.doFinal(bytearray(plain)))).decode()

    text = json.dumps({"a": "é" * 100})
    rows = [("s", sealed(b"\x00" + text.encode(), "s\n000000"), bytearray(key)), ("s", sealed(b"\x01" + gzip.compress(text.encode()), "s\n000000"), bytearray(key)), ("s", sealed(b"\x02" + text.encode(), "s\n000000"), bytearray(key))]
    df = spark.createDataFrame(rows, "stream_id string, data string, key binary")
    aad = crypto.payload_aad(F.col("stream_id"), F.lit("000000"))
    assert [r[0] for r in df.select(crypto.decrypt(F.col("data"), F.col("key"), aad)).collect()] == [text, text, None]
    with pytest.raises(Exception, match="none was announced"):
        df.select(crypto.decrypt(F.col("data"), F.col("key"), aad, compressed=False)).collect()


def test_markers_are_told_by_type(spark):
    fields = ['{"$enc":"x"}', '{"$enc":5}', '{"$enc":null}', '{"$shredded":true}', '{"$shredded":"true"}', '{"$shredded":false}', '"$enc"', "[1]", "broken", None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "i int, f string")
    got = df.orderBy("i").select(F.coalesce(crypto.is_field_envelope(F.col("f")), F.lit(False)), F.coalesce(crypto.is_shredded_field(F.col("f")), F.lit(False))).collect()
    assert [i for i, r in enumerate(got) if r[0]] == [0] and [i for i, r in enumerate(got) if r[1]] == [3]


def test_fields_of_one_event(spark):
    notes = spark.createDataFrame([("T", ["a", "absent"], False), ("P", None, True)], "type string, fields array<string>, plaintext boolean")
    events = spark.createDataFrame([("s", 0, "T", '{"who":"u","a":[1,{"b":null}],"z":1.5}'), ("s", 1, "P", '{"a":1}'), ("$sys", 0, "X", '"open"')], "stream_id string, version long, type string, data string")
    keys = spark.createDataFrame([("u", "000002", bytearray(range(32)))], "subject string, key_id string, key binary")
    who = crypto.subject_in("who")
    stored = crypto.encrypt_fields(crypto.gated(events, notes, who).where("reason IS NULL"), keys)
    got = {(r.stream_id, r.version): r for r in stored.collect()}
    assert got["s", 1].data == '{"a":1}' and got["s", 1].key_id is None and got["$sys", 0].data == '"open"'
    assert '"who":"u"' in got["s", 0].data and '"z":1.5' in got["s", 0].data and '"keyId"' not in got["s", 0].data and got["s", 0].key_id == "000002"
    back = {(r.stream_id, r.version): r.data for r in crypto.decrypt_fields(stored, keys.withColumn("status", F.lit("ok")), who).collect()}
    assert back["s", 0] == '{"who":"u","a":[1,{"b":null}],"z":1.5}'
    gone = keys.withColumn("key", F.lit(None).cast("binary")).withColumn("status", F.lit("erased"))
    assert '"a":{"$shredded":true}' in {r.version: r.data for r in crypto.decrypt_fields(stored.where("stream_id = 's'"), gone, who).collect()}[0]
    with pytest.raises(Exception, match="never minted"):
        crypto.decrypt_fields(stored, gone.limit(0), who).collect()
    with pytest.raises(Exception, match="erased"):
        crypto.encrypt_fields(crypto.gated(events, notes, who).where("reason IS NULL"), keys.limit(0)).collect()


def test_compaction_outcomes(spark):
    tail = spark.createDataFrame([("a", i) for i in range(8)] + [("b", i) for i in range(3, 6)] + [("c", 0)], "stream_id string, base_version long")
    listed = spark.createDataFrame([("b", 0)], "stream_id string, chunk_base long")
    raced = listed.unionByName(spark.createDataFrame([("a", 0)], "stream_id string, chunk_base long"))
    got = layout.compaction_outcomes(tail, raced, listed, 3)
    assert {r.stream_id: (r.bucket, r.status) for r in got.collect()} == {"a": (0, "stood-down"), "b": (3, "nothing-to-do"), "c": (0, "nothing-to-do")}
    assert sorted(map(tuple, layout.without_sources(tail, got, 3).where("stream_id = 'a'").collect())) == [("a", i) for i in range(3, 8)]
    gap = spark.createDataFrame([("a", 7)], "stream_id string, base_version long")
    with pytest.raises(Exception, match="without commits"):
        layout.compaction_outcomes(gap, listed.limit(0), listed.limit(0), 3).collect()


def test_compaction_of_a_bucket_that_one_commit_reaches_over(spark):
    tail = spark.createDataFrame([("a", 7)], "stream_id string, base_version long")
    listed = spark.createDataFrame([("a", 0, 6)], "stream_id string, chunk_base long, last_version long")
    chunks = listed.select("stream_id", "chunk_base")
    assert [tuple(r) for r in layout.compaction_outcomes(tail, chunks, listed, 3).collect()] == [("a", 3, "compacted")]
    with pytest.raises(Exception, match="without commits"):  # the chunk ends within the bucket
        layout.compaction_outcomes(tail, chunks, listed.withColumn("last_version", F.lit(4).cast("long")), 3).collect()


def test_a_gap_in_a_read_fails(spark):
    whole = spark.createDataFrame([("s", 0, 2), ("s", 2, 1), ("s", 3, 4), ("t", 0, 1)], "stream_id string, base_version long, commit_size long")
    assert layout.contiguous(whole).count() == 4 and sorted(r.base_version for r in layout.contiguous(whole).collect()) == [0, 0, 2, 3]
    with pytest.raises(Exception, match="discontiguous at base 3"):
        layout.contiguous(whole.where("base_version <> 2")).collect()
    assert [tuple(r) for r in layout.discontiguous(whole.where("base_version <> 2")).select("base_version", "expected").collect()] == [(3, 2)]


def test_a_stored_log_pushes_its_filters(spark, tmp_path):
    at = str(tmp_path / "log")
    log_of(spark, 100).repartition("stream_id").sortWithinPartitions("stream_id", "version").write.parquet(at)
    plan = replay.replay(spark.read.parquet(at), 5, 25)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(version,5)" in plan and "LessThan(version,25)" in plan


def test_folds_of_empty_ranges_and_long_streams(spark):
    log = log_of(spark, 5)
    streams = spark.createDataFrame([("s",), ("none",)], "stream_id string")
    got = {r.stream_id: (r.version, r.state) for r in transform.fold_in_order(log, F.col("data").cast("long"), F.lit(1).cast("long"), lambda s, x: s * 2 + x, 3, streams).collect()}
    assert got == {"s": (4, 14), "none": (2, 1)}
    assert tuple(transform.fold_sorted(log, F.col("data").cast("long"), 1, lambda s, x: s * 2 + x, "long", 3).first()) == ("s", 4, 14)


def test_client_read_by_shape(spark):
    keys = spark.createDataFrame([("s", "000000", bytearray(range(32)))], "stream_id string, key_id string, key binary")
    whole = crypto.encrypt_payloads(log_of(spark, 1), keys).withColumn("data", F.concat(F.lit('"'), "data", F.lit('"')))
    plain = log_of(spark, 2).where("version = 1").withColumn("key_id", F.lit(None).cast("string"))
    marked = plain.withColumns({"version": F.lit(2).cast("long"), "data": F.lit('{"a":{"$enc":"x"},"b":1}'), "key_id": F.lit("000000")})
    stored = whole.unionByName(plain).unionByName(marked)
    up = lambda x: x.withColumn("type", F.concat("type", F.lit("2")))
    got = {r.version: (r.type, r.data) for r in transform.client_read(stored, keys, upcasters=[up]).collect()}
    assert got == {0: ("E2", "0"), 1: ("E2", "1"), 2: ("E2", '{"a":{"$enc":"x"},"b":1}')}
    with pytest.raises(Exception, match="not deliverable"):
        transform.client_read(stored, keys.limit(0)).collect()


def test_a_ciphertext_is_opened_once(spark):
    keys = spark.createDataFrame([("s", "000000", bytearray(range(32)))], "stream_id string, key_id string, key binary")
    log = log_of(spark, 1).withColumn("key_id", F.lit("000000"))
    plan = crypto.decrypt_payloads(log, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("aesdecrypt") == 1
    notes = spark.createDataFrame([("E", ["k"], False)], "type string, fields array<string>, plaintext boolean")
    log = log.withColumn("type", F.concat("type", "id"))  # no constant
    plan = crypto.gated(log, notes, crypto.subject_in("who"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(type" not in plan
