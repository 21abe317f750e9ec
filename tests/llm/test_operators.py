"""Corpus operators against brute force, round trips and invariants on small inputs with the
awkward rows: nulls, empty and long texts, repeats, ties, empty tables, extra columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandbook.llm import fingerprints, idfiles, language, links, mixing, neardup, neighbours, packing, quality, substrings, surrogates, tokens

SMALL = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 40, 120, 400]))) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.01 else "changed" for w in t.split()) for t in base[:20]]
    long = " ".join(rng.choices(words, k=6000))
    return [*base, *near, base[0], base[0].upper() + "!", "", "", None, None, "!?", "x", long, long + " end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, TEXT).withColumn("part", F.lit(1)).withColumn("bands", F.lit("x")).withColumn("name", F.lit("y"))


def nothing(docs):
    return docs.limit(0)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(0, i) for i in range(290, 300)]
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in range(300) if find(i) != i}


def test_near_classes_equal_brute_force(docs):
    known = {r.doc_id: r.text for r in docs.collect()}
    hashed = dict(zip(known, neardup.words_of([t or "" for t in known.values()]), strict=True))
    vec = {i: neardup.shingles(h) for i, h in hashed.items() if len(h)}
    df = Counter(x for s, _ in vec.values() for x in s.tolist())
    n = sum(t is not None for t in known.values())
    weights = neardup.Weights({k: v for k, v in df.items() if v * neardup.RARE >= n}, n)
    weighted = {i: (s, weights.of(s, tf)) for i, (s, tf) in vec.items()}
    root = {i: i for i in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(known)
    for a in ids:
        for b in ids:
            same = known[a] is not None and known[a] == known[b]
            if a < b and (same or (a in weighted and b in weighted and neardup.similarity(weighted[a], weighted[b]) >= 0.8)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    assert got == {i: find(i) for i in ids}
    assert neardup.near_classes(nothing(docs)).count() == 0
    kept = neardup.keep_one(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs.columns


@pytest.mark.parametrize("how", [{}, {"slice_bytes": 900, "held": 2}, {"slice_bytes": 3000, "hot": 2}, {"slice_bytes": 1500, "hot": 1, "held": 1}])
def test_repeats_equal_brute_force(spark, docs, how):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcde fghij", k=900))
    odd = [("x" + passage[:k] + str(k) * 300 + passage[k:]) for k in range(0, 900, 45)] + ["ab" * 700, "ab" * 350 + "z", "é" * 500, passage + passage]
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", None, len(t), 1, "x", "y") for i, t in enumerate(odd)], docs.schema))
    some = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen = Counter(t[s : s + 400] for t in some.values() for s in range(len(t) - 399))
    want = {}
    for i, t in some.items():
        cover = np.zeros(len(t), bool)
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                cover[s : s + 400] = True
        want[i] = (len(t), int(cover.sum()), int((np.diff(np.r_[False, cover].astype(int)) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~cover]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs, **how).collect()}
    assert got == want
    assert substrings.remove_repeats(nothing(docs)).count() == 0


def test_repeated_rows_lose_everything_long(spark):
    text = "".join(random.Random(3).choices("abcdefgh ", k=1000))
    rows = [(7, text), (7, text), (7, "short"), (7, "short"), (None, text[:399]), (None, None)]
    got = sorted((r.n_bytes, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (399, 0), (1000, 1000), (1000, 1000)]


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(known)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        new = fingerprints.edited(known[a], known[b])
        assert got[a].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[a].n_chars == len(known[a])
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
        assert got[a].near_next == fingerprints.likeness(fingerprints.decode(got[a].fingerprint), fingerprints.decode(got[b].fingerprint))
    same = defaultdict(set)
    for i in ids:
        same[known[i]].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)
    assert fingerprints.fingerprints(nothing(docs)).count() == 0


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[100:130] = x[100]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)), k=10, every=20).collect()
    found, score = defaultdict(list), {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
        score[r.query_id, r.vec_id] = r.score
    exact = x @ x.T
    hits = 0
    for q in range(0, 600, 20):
        best = [i for i in sorted(range(600), key=lambda i: (-exact[q, i], i)) if i != q][:10]
        hits += len(set(best) & set(found[q]))
        assert len(found[q]) == 10 and q not in found[q]
    assert hits >= 0.9 * 300
    assert all(abs(s - exact[a, b]) < 1e-9 for (a, b), s in score.items())


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokens.vocabulary()
    plain = Tokenizer.from_file(path)
    some = [t or "" for t in texts()] + ["It's 12 o'clock — naïve Ünïcode, <|endoftext|> 中文"]
    for t, ids in zip(some, tokens.Encoder(path).encode(some), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing(docs):
    rows = packing.pack(docs, capacity=128).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 128
    for p in pieces.values():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(p)):
            assert (piece, start) == (n, at) and length <= 128
            at += length
    assert len(pieces) == docs.count()
    assert packing.pack(nothing(docs)).count() == 0


def test_id_files_round_trip(spark, docs, tmp_path):
    got = {r.doc_id: r for r in idfiles.read(spark, idfiles.write(docs, str(tmp_path / "ids"))).collect()}
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    start = 0
    for i, ids in zip(sorted(known), tokens.Encoder(tokens.vocabulary()).encode([known[i] for i in sorted(known)]), strict=True):
        want = np.append(ids, 2).astype("<u4").tobytes()
        assert (got[i].start, got[i].n_tokens) == (start, len(ids) + 1) and zlib.crc32(bytes(got[i].ids)) == zlib.crc32(want)
        start += len(ids) + 1


def test_mix_stays_within_a_block(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("source"))
    rows = mixing.mix(docs, weights={"a": 1.0, "b": 2.0, "": 1.0}).select("doc_id", "slot", "release", "deadline", "position").collect()
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    assert len({r.position for r in rows}) == 4000
    shares = mixing.whole_shares({0: 1.0, 1: 2.0, 2: 1.0}, 64)
    for lane, places in mixing.one_period(shares).items():
        for i, slot in enumerate(places):
            assert abs((i + 1) - (slot + 1) * shares[lane] / 64) < 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_surrogates(spark):
    rows = [(0, "Mail ann@x.org or ANN@x.org, call +1 202-555-0100; Mrs Ada Byron."), (1, "ann@x.org and bob@y.net at 10.1.2.3, Mrs Ada Byron"), (2, None), (3, ""), (4, "nothing here")]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(0))).collect()}
    assert got[2].text is None and got[3].text == "" and got[4].text == "nothing here" and got[4].found == []
    assert "ann@" not in got[0].text.lower() and "Ada Byron" not in got[0].text and "10.1.2.3" not in got[1].text
    first = got[1].text.split()[0]
    assert first in got[0].text and first != got[1].text.split()[2]
    assert got[0].text.split("Mrs ")[1].rstrip(".") == got[1].text.split("Mrs ")[1]


def test_language_and_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    q = language.op4_byte_cnn_language(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in q) >= 0.9 * len(q)
    s = quality.op8_byte_cnn_quality(spark, SMALL)
    assert s.count() == docs.count() and s.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "123 !"), (3, "ab")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, language.fit(docs)).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und"
    assert quality.score(odd, quality.fit(docs, labels)).count() == 4
    assert language.fit(docs.limit(0)) is None and quality.fit(docs.limit(0), labels) is None


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in neardup.near_classes(docs).where("doc_id = class_id").collect()}
    assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) >= 0.9 * len(kept)


def test_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    size = 256
    monkeypatch.setattr(packing, "RANGE_ROWS", size, raising=False)
    rng = random.Random(5)
    # the hot source has the long documents, so an order by length would tell the sources apart
    rows = [(i, " ".join(["word"] * rng.randint(*((1000, 3000) if i % 4 else (1, 40)))), "hot" if i % 4 else f"s{i % 12}") for i in range(4000)]
    corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "source", "position", "lane_weight").collect()
    place = {r.doc_id: r.position for r in mixed}
    source, target = {r.doc_id: r.source for r in mixed}, {r.source: r.lane_weight for r in mixed}
    assert {r.doc_id for r in out} == set(place) and len(out) > len(place)
    ends = {}
    for r in sorted(out, key=lambda r: r.sequence_id):
        ends.setdefault(place[r.doc_id] // size, []).append(r.sequence_id)
    spans = [(min(v), max(v)) for _, v in sorted(ends.items())]
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    for n, (_, last) in enumerate(spans[:5]):  # all sources still last
        count = Counter(source[i] for i in {r.doc_id for r in out if r.sequence_id <= last})
        for s, w in target.items():
            assert abs(count[s] - w * (n + 1) * size) <= 2 * mixing.BLOCK_ROWS
    assert sorted({r.sequence_id for r in out}) == list(range(spans[-1][1] + 1))
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.CAPACITY
    assert packing.pack_in_order(spark.createDataFrame([], "doc_id long, text string, position long")).count() == 0


@pytest.mark.parametrize("weights", [[1 / 3, *[2 / 3 / 49] * 49], [0.9999, 0.0001], [0.37, *[0.63 / 19] * 19], [5.0, 1e-7, 0.3]])
def test_mix_keeps_the_exact_target(weights):
    whole = mixing.whole_weights(dict(enumerate(weights)))
    assert all(whole[i] * weights[0].as_integer_ratio()[0] * w.as_integer_ratio()[1] == whole[0] * w.as_integer_ratio()[0] * weights[0].as_integer_ratio()[1] for i, w in enumerate(weights))
    blocks = {i: max(1, int(20_000 * w / sum(weights))) + i % 3 for i, w in enumerate(weights)}
    had, seen = Counter(), 0
    fluid, used = dict.fromkeys(blocks, 0.0), set()
    for slot, (lane, block, release, deadline, at) in enumerate(mixing.schedule(blocks, whole)):
        assert at == slot and release <= slot < deadline and block == had[lane]
        had[lane] += 1
        seen += 1
        room = 1.0  # the fluid mix goes on by one slot; lanes run out inside it
        while room > 1e-12 and len(used) < len(blocks):
            rate = sum(weights[i] for i in blocks if i not in used)
            span = min(room, min((blocks[i] - fluid[i]) * rate / weights[i] for i in blocks if i not in used))
            for i in blocks:
                if i not in used:
                    fluid[i] += weights[i] / rate * span
            used |= {i for i in blocks if i not in used and blocks[i] - fluid[i] < 1e-9}
            room -= span
        if slot % 7 == 0 or slot < 50:
            assert all(abs(had[i] - fluid[i]) < 1 + 1e-6 for i in blocks)
    assert had == blocks and seen == sum(blocks.values())


def test_mix_reports_the_target(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("often").alias("source"))
    rows = mixing.mix(docs, weights={"often": 0.9999, "rare": 0.0001}).collect()
    assert {r.source: round(r.lane_weight, 12) for r in rows} == {"often": 0.9999, "rare": 0.0001}
    assert all(r.release <= r.slot < r.deadline and r.position // mixing.BLOCK_ROWS == r.slot for r in rows)
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"often": 1.0, "rare": 0.0})


def test_mix_of_many_sources(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") < 3000, F.col("id") % 299).otherwise(F.lit(299) + F.col("id") % 2)).alias("source"))
    docs = docs.unionByName(spark.range(9000, 9040).select(F.col("id").alias("doc_id"), F.lit("small").alias("source")))
    names = [f"s{i}" for i in range(301)] + ["small"]
    weights = {s: 1.0 for s in names} | {"small": 100.0}
    rows = mixing.mix(docs, weights=weights).collect()
    assert sorted(r.doc_id for r in rows) == list(range(9040))
    assert {r.source: r.lane_weight for r in rows} == {s: w / 401 for s, w in weights.items()}
    assert all(r.release <= r.slot < r.deadline for r in rows)
    # five blocks at a target of about a quarter of the slots are over within 21 slots
    assert max(r.slot for r in rows if r.source == "small") <= 21
    plain = mixing.mix(docs).collect()
    own = Counter(r.source for r in plain)
    of_all = sum((n / 9040) ** mixing.FLATTEN for n in own.values())
    assert all(abs(r.lane_weight - (own[r.source] / 9040) ** mixing.FLATTEN / of_all) < 1e-12 for r in plain)


def recall(spark, x, every, k=20):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    found = defaultdict(list)
    for r in sorted(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=k, every=every).collect(), key=lambda r: r.rank):
        found[r.query_id].append(r.vec_id)
    exact, hits, wanted = x @ x.T, 0, 0
    for q in range(0, len(x), every):
        best = [i for i in np.argsort(-exact[q], kind="stable").tolist() if i != q][:k]
        assert len(found[q]) == len(best)
        hits, wanted = hits + len(set(best) & set(found[q])), wanted + len(best)
    return hits / wanted


def test_neighbours_of_tiny_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    assert recall(spark, rng.normal(size=(15, 64)), 1) == 1
    assert recall(spark, rng.normal(size=(2, 64)), 1) == 1


@pytest.mark.parametrize("norms", ["one long", "lognormal"])
def test_neighbours_of_uneven_norms(spark, norms):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 64))
    x = centres[rng.integers(100, size=4000)] + 0.5 * rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.lognormal(size=(4000, 1)) if norms == "lognormal" else np.where(np.arange(4000) == 7, 20.0, 1.0)[:, None]
    got = recall(spark, x, 40)
    print(norms, got)
    assert got >= 0.95


def test_frequent_runs_are_kept_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_RUNS", 60)
    encoder = tokens.Encoder(tokens.vocabulary())
    for k in range(12):
        texts = ["the common words of every batch " + " ".join("x" + "abcdefghijkl"[k] + "abcdefghijkl"[i] * 3 for i in range(12))]
        assert encoder.encode(texts)[0].tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
        assert len(encoder.number) <= 60 and (k < 2 or {"the", "common", "batch"} <= set(encoder.number))
    assert len(encoder.number) == len(encoder.length) == len(encoder.first) == len(encoder.again)
    learned = []
    monkeypatch.setattr(encoder, "_learn", lambda runs, learn=encoder._learn: (learned.extend(runs), learn(runs)))
    encoder.encode(["common new"] + ["yy" + a + b for a in "abcdef" for b in "abcde"])
    assert "new" in learned and "common" not in learned


def test_runs_are_split_as_the_vocabulary_says():
    import regex

    said = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    usual = "".join(c for c in map(chr, range(0x3000)) if tokens.UNUSUAL.search(c) is None).lower()
    for text in (usual, " a".join(usual), "1".join(usual), "it's we'll 12\xa0½ ñandú—n'a"):
        assert tokens.RUNS.findall(text) == said.findall(text)
