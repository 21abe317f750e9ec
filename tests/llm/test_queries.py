"""The registered queries on whole small tables, and awkward rows, against plain Python."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandbook.llm import fingerprints, idfiles, language, mixing, neardup, neighbours, packing, quality, queries, substrings, tokens

SMALL = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("name", "first", "length", "order", "rank", "start", "salt", "lane", "block", "part", "row", "at", "span", "to", "key", "bands", "size", "position", "offset", "range", "v", "digest")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "délta", "x"], k=120_000))
    rows = [(1, "one text here", "en", "a", 1), (1, "one text here", "en", "a", 1), (1, "another text", "en", "b", 1), (None, "no id", None, None, None), (None, None, None, None, None), (2, None, "en", "a", 0), (3, "", None, "", 0), (4, long, "en", "a", 9), (5, "!!! 123", "en", None, 3), (6, "𝒳 emoji 😀 and \u0000 zero", "en", "c", 3)]
    df = spark.createDataFrame(rows, TEXT)
    return rows, df.withColumns({c: F.lit("kept") for c in CLASHING})


def test_encoder_equals_the_tokenizer_on_all_documents(documents, plain):
    texts = list(documents.values())
    for t, ids in zip(texts, tokens.Encoder(tokens.vocabulary()).encode(texts), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids


def test_op1(spark, documents):
    got = {r.doc_id: r for r in fingerprints.op1_merkle_fingerprints(spark, SMALL).collect()}
    ids = sorted(documents)
    assert sorted(got) == ids

    def leaves(fingerprint):
        return Counter(x for s in fingerprint.split("/")[1:] for p in s.split(":")[1].split(";") for x in p.split(",")[1:])

    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        r, text, following = got[a], documents[a], documents[b]
        n = len(text) // 2
        new = text[: len(text) - n] + following[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        for other, near in ((r.edited_fingerprint, r.near_edited), (got[b].fingerprint, r.near_next)):
            x, y = leaves(r.fingerprint), leaves(other)
            total = sum(x.values()) + sum(y.values())
            want = 1.0 if r.fingerprint.split("/")[0] == other.split("/")[0] else 2 * sum((x & y).values()) / total if total else 0.0
            assert near == pytest.approx(want, abs=1e-12)
        theirs = {p.split(",")[0] for s in r.edited_fingerprint.split("/")[1:] for p in s.split(":")[1].split(";")}
        whole = {s.split(":")[0] for s in r.edited_fingerprint.split("/")[1:]}
        mine = [(s.split(":")[0], p.split(",")[0]) for s in r.fingerprint.split("/")[1:] for p in s.split(":")[1].split(";")]
        assert r.n_differing == (0 if new == text else sum(s not in whole and p not in theirs for s, p in mine))


def test_op6(spark, documents, plain):
    rows = packing.op6_large_item_packing(spark, SMALL).collect()
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in documents.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        assert sorted(pieces[i]) == list(range(-(-len(ids) // 2048)))
        for n, r in pieces[i].items():
            own = ids[n * 2048 : (n + 1) * 2048]
            assert (r.start, r.length, r.ids_crc32) == (n * 2048, len(own), zlib.crc32(own.tobytes()))
    for p in places.values():
        p.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:], strict=False)) and p[0][0] == 0 and p[-1][0] + p[-1][1] <= 2048
    total = sum(r.length for r in rows)
    assert len(places) <= 1.03 * max(-(-total // 2048), sum(2 * r.length > 2048 for r in rows)) + 1


def test_plans_are_near_the_lower_bound():
    rng = np.random.default_rng(6)
    for lengths in (rng.integers(1, 2049, 20_000), rng.integers(1, 400, 20_000), np.minimum(rng.geometric(1 / 700, 20_000), 2048)):
        values, counts = np.unique(lengths, return_counts=True)
        bins = packing.plan_bins(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        assert Counter({n: c for n, c in zip(values.tolist(), counts.tolist(), strict=True)}) == sum((Counter({n: c * k for n, k in Counter(x).items()}) for c, x in bins), Counter())
        assert all(sum(x) <= 2048 and sum(3 * n > 2048 for n in x) <= 2 for _, x in bins)
        assert sum(c for c, _ in bins) <= 1.01 * max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum())) + 1


def test_op9(spark, documents, plain):
    got = {r.doc_id: r for r in idfiles.op9_dictionary_id_files(spark, SMALL).collect()}
    start = 0
    for i in sorted(documents):
        ids = np.array([*plain.encode(documents[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op10_output_stays_within_a_block(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source")
    n = Counter(r.source for r in docs.collect())
    for weights in (None, {s: 1.0 for s in n if s is not None}, {s: 1 + 7.3 * i for i, s in enumerate(sorted(x for x in n if x))}):
        rows = mixing.mix(docs, weights, block_rows=2).collect()
        assert len(rows) == sum(n.values()) and len({r.position for r in rows}) == len(rows)
        share = {r.source: r.lane_weight for r in rows}
        assert sum(share.values()) == pytest.approx(1)
        if weights:
            assert all(share[s] / share[t] == pytest.approx(weights[s] / weights[t]) for s in weights for t in weights)
        slots = sorted({(r.slot, r.source) for r in rows})
        last = {s: max(slot for slot, x in slots if x == s) for s in n}
        had = Counter()
        for slot, source in slots:
            if slot > min(last.values()):
                break  # from here on sources have run out
            had[source] += 1
            assert all(abs(had[s] - share[s] * (slot + 1)) < 1 + 1e-9 for s in n)


def test_op10_blocks_grow_with_the_corpus(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs, {"a": 1.0, "b": 1.0}, most_blocks=100).collect()
    assert len({r.position for r in rows}) == 5000 and len({r.slot for r in rows}) == 100
    had = Counter(r.source for r in rows if r.position < 1000)
    assert abs(had["a"] - 500) <= 50


def test_op10_weights_change_the_result(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    first = lambda w: Counter(r.source for r in mixing.mix(docs, w).where("position < 400").collect())
    assert first({"a": 9.0, "b": 1.0})["a"] == pytest.approx(360, abs=8) and first({"a": 1.0, "b": 1.0})["a"] == pytest.approx(200, abs=8)


def test_classifiers_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert good and bad and np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.95
    named = language.op4_byte_cnn_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in named]) >= 0.97
    rare = docs.where("lang IS NOT NULL").withColumn("lang", F.when(F.col("doc_id") % 100 == 1, "rare").otherwise(F.col("lang")))
    assert "rare" in language.fit(rare)[1]


def test_awkward_rows(spark, tmp_path, plain):
    rows, docs = awkward(spark)
    n = len(rows)
    assert fingerprints.fingerprints(docs).count() == n
    out = language.identify(docs, language.fit(docs))
    assert out.count() == n and set(docs.columns) <= set(out.columns) and {r.lang_pred for r in out.where("text IS NULL OR text = '' OR text LIKE '!!!%'").collect()} == {"und"}
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (None, 1), (9, None)], "doc_id long, quality long")
    assert quality.score(docs, quality.fit(docs, labels)).where("score BETWEEN 0 AND 1").count() == n
    cut_up = substrings.remove_repeats(docs, slice_bytes=5000)
    assert cut_up.count() == n and cut_up.where("doc_id = 4").first().n_removed == 0
    classes = {(r.doc_id, r.class_id) for r in neardup.near_classes(docs).collect()}
    assert classes == {(i, i) for i in (1, 2, 3, 4, 5, 6)} | {(None, None)}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 2}
    pieces = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r[0] for r in rows)
    places = [(r.sequence_id, r.offset) for r in pieces]
    assert len(set(places)) == len(places)
    mixed = mixing.mix(docs)
    assert mixed.count() == n and {r.salt for r in mixed.collect()} == {"kept"} and set(docs.columns) - {"lane", "block", "position"} <= set(mixed.columns)
    read = idfiles.read(spark, idfiles.write(docs, str(tmp_path / "ids"))).collect()
    assert Counter(r.doc_id for r in read) == Counter(r[0] for r in rows)
    want = Counter(zlib.crc32(np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for r in rows)
    assert Counter(zlib.crc32(bytes(r.ids)) for r in read) == want
    starts = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in read)
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(starts, starts[1:], strict=False))
    none = docs.limit(0)
    assert idfiles.read(spark, idfiles.write(none, str(tmp_path / "none"))).count() == 0
    assert packing.pack(none).count() == mixing.mix(none).count() == substrings.remove_repeats(none).count() == fingerprints.fingerprints(none).count() == 0
    assert language.identify(none, None).count() == quality.score(none, None).count() == 0


def test_awkward_vectors(spark):
    v = [[1.0, 0.0], [0.0, 2.0], [1.0, 1.0], None, [0.0, 0.0], [float("inf"), 1.0], [float("nan"), 1.0], [1.0, None], [3.0, 4.0]]
    rows = [(i * 20, x) for i, x in enumerate(v)] + [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("digest", "v", "q", "cell", "rank", "score", "n", "norm", "span")})
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    able = {0: [1, 0], 1: [1, 0], 2: [1, 0], 20: [0, 2], 40: [1, 1], 160: [3, 4]}
    for q in (0, 20, 40, 160):
        assert got[q] == sorted(((i, float(np.dot(able[q], x))) for i, x in able.items() if i != q), key=lambda p: (-p[1], p[0]))
    assert sorted(got) == [0, 20, 40, 160]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_idf_changes_an_outcome():
    """A passage in most documents weighs less: two texts that share little else are kept apart."""
    frequent = list(neardup.words_of([" ".join(f"common{i}" for i in range(88))]))[0]
    own = [list(neardup.words_of([" ".join(f"own{k}x{i}" for i in range(9))]))[0] for k in range(2)]
    sets = [neardup.shingles(np.concatenate([frequent, o])) for o in own]
    shared = set(sets[0][0].tolist()) & set(sets[1][0].tolist())
    flat, weighted = neardup.Weights({}, 100), neardup.Weights({x: 90 for x in shared}, 100)
    at = lambda w: neardup.similarity(*[(s, w.of(s, tf)) for s, tf in sets])
    assert at(flat) >= 0.75 > at(weighted)


def test_every_shingle_has_a_document_count(spark):
    """A passage in 5 % of the documents keeps short texts apart that are 0.82 alike by counts alone."""
    passage = " ".join(f"passage{i}" for i in range(95))
    texts = [f"{passage} " + " ".join(f"own{k}x{i}" for i in range(10)) for k in range(10)]
    texts += [" ".join(f"other{k}x{i}" for i in range(60)) for k in range(188)]
    texts += [" ".join(f"near{i}" for i in range(100)) + end for end in (" one", " two")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = neardup.weights(docs.select("text").repartition(3))
    s, tf = neardup.shingles(list(neardup.words_of([passage]))[0])
    assert np.allclose(np.median(known.of(s, tf)), neardup.idf(np.array([10.0]), 200)) and neardup.idf(np.ones(1), 200)[0] == 2
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    assert got == {i: 198 if i == 199 else i for i in range(200)}


def test_document_counts_stay_on_the_executors(spark):
    """The driver holds 4 bytes for each counter and no counts."""
    texts = spark.createDataFrame([(" ".join(f"word{k}x{i}" for i in range(40)),) for k in range(50)], "text string").repartition(5)
    tracemalloc.start()
    try:
        known = neardup.weights(texts)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert known.idf.value.dtype == np.float32 and len(known.idf.value) == neardup.COUNTERS
    assert peak < 12 * neardup.COUNTERS
    s, tf = neardup.shingles(list(neardup.words_of(["in none of the documents"]))[0])
    assert (known.of(s, tf) == 2).all()
    none = neardup.weights(texts.limit(0))
    assert (none.idf.value == 1).all()


def test_pipeline_stages_against_plain_python(spark, plain):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["the", "of", "and", "water", "house", "river", "stone", "morning", "light", "voice", "under", "every", "garden", "winter"]
    texts = [" ".join(rng.choices(words, k=rng.choice([30, 60, 200]))) for _ in range(60)]
    near = [t.replace("river", "river", 1) + " end" for t in texts[:10]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t in enumerate([*texts, *near, *texts[:5], "", "!!!"])] + [(200, None, None, None, None), (0, texts[0], "en", "s0", len(texts[0])), (201, "Mail ann@x.org please, " + texts[20], "en", "s1", 9), (None, texts[30], "en", None, 3)]
    docs = spark.createDataFrame(rows, TEXT)
    run = dict(corpus_pipeline.STAGES)
    # language: every row with letters is English here; null, empty and unlettered texts go
    named = run["language"](spark, docs, "")
    assert named.columns == docs.columns and Counter(r.doc_id for r in named.collect()) == Counter(r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    # near-duplicates: brute force over the words' shingles
    known = {r.doc_id: r.text for r in named.collect() if r.doc_id is not None}
    sets = {i: Counter(tuple(t.lower().replace("@", " ").replace(".", " ").replace(",", " ").split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) for i, t in known.items()}
    df = Counter(x for s in sets.values() for x in s)
    weigh = lambda s: {x: c * (1 + np.log2(np.clip(len(known) / df[x], 1, 16)) / 4) for x, c in s.items()}
    weighted, root = {i: weigh(s) for i, s in sets.items()}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            least = sum(min(w, weighted[b].get(x, 0)) for x, w in weighted[a].items())
            if a < b and least / (sum(weighted[a].values()) + sum(weighted[b].values()) - least) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = run["near_duplicates"](spark, named, "")
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*{find(i) for i in sets}, None])
    safe = run["personal_data"](spark, kept, "")
    assert safe.columns == docs.columns and safe.count() == kept.count() and safe.where("text LIKE '%ann@%'").count() == 0
    assert safe.where("n_chars <> char_length(text)").count() == 0
    mixed = run["mixing"](spark, safe, "")
    assert len({r.position for r in mixed.collect()}) == kept.count()
    out = run["packing"](spark, mixed, "").collect()
    texts_of = defaultdict(list)
    for r in mixed.collect():
        texts_of[r.doc_id].append(zlib.crc32(np.array([*plain.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()))
    assert {i: sorted(x) for i, x in texts_of.items()} == {i: sorted(r.ids_crc32 for r in out if r.doc_id == i) for i in texts_of}
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0, name


def test_every_query_has_a_docstring():
    assert len(queries.queries()) == 10 and all(q.__doc__ for q in queries.queries().values())
