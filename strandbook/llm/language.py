"""Language identification by a byte convolutional network over fixed-length windows.

The network is trained on a bounded sample of labelled rows that are not held out and applied to
every window of every whole text; a document's language is the class with the largest mean
probability over its windows, and its score is that mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN, softmax
from .common import few_by, held_out, parts_of, small_batches, table

WINDOW = 256
SAMPLE_DOCS = 2_000  # bound of the labelled rows that the classifier learns from
SAMPLE_WINDOWS = 3  # windows of each of them, spread over the text
EPOCHS, BATCH, RATE = 8, 64, 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows as uint8 rows, number of windows of each text): together they cover every byte.

    A text's last window ends with the text; a text shorter than a window is filled with zeros."""
    parts, count = [], []
    for t in texts:
        whole = len(t) // WINDOW
        if not whole:
            parts.append(t.ljust(WINDOW, b"\0"))
            count.append(1)
        else:
            parts.append(t[: whole * WINDOW])
            if len(t) % WINDOW:
                parts.append(t[-WINDOW:])
            count.append(whole + (len(t) % WINDOW > 0))
    return np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, WINDOW), np.array(count, dtype=np.int64)


def train(samples: list[tuple[str, list[bytes]]], seed: int = 0) -> tuple[ByteCNN, list[str]]:
    """(language, windows of WINDOW bytes) of each document -> network and its languages in order."""
    langs = sorted({lang for lang, _ in samples})
    net = ByteCNN(len(langs), seed=seed)
    x = np.stack([np.frombuffer(w, dtype=np.uint8) for _, ws in samples for w in ws])
    y = np.array([langs.index(lang) for lang, ws in samples for _ in ws])
    rng, state = np.random.default_rng(seed), {}
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            part = order[lo : lo + BATCH]
            z, where = net.forward(x[part])
            d = softmax(net.logits(z))
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            g = net.gradients(x[part], z, where, d @ net.p["head"].T)
            net.adam(g | {"head": z.T @ d, "out": d.sum(0)}, state, RATE / (1 + epoch))
    return net, langs


def fit(docs: DataFrame) -> tuple[ByteCNN, list[str]] | None:
    """Learns from text and lang of at most SAMPLE_DOCS documents that are not held out, as many of each
    language as there are, up to its equal share, so a rare language is learned too.

    A repeated doc_id is learned once, with the least of its languages and texts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    few = few_by(known.select("doc_id", "lang"), "lang", SAMPLE_DOCS)
    each = known.join(F.broadcast(few), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("least"))
    sample = each.select("doc_id", "least.lang", F.encode("least.text", "UTF-8").alias("bytes"))
    step = F.greatest(F.length("bytes") - WINDOW, F.lit(0)) / F.lit(max(1, SAMPLE_WINDOWS - 1))
    picked = [F.substring("bytes", (F.lit(1) + F.floor(step * i)).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    rows = sample.select("doc_id", "lang", F.array_distinct(F.array(*picked)).alias("windows")).collect()
    rows = sorted((r["doc_id"], r["lang"], [bytes(w).ljust(WINDOW, b"\0") for w in r["windows"]]) for r in rows if LETTER.search(b"".join(map(bytes, r["windows"])).decode("utf-8", "ignore")))
    return train([(lang, ws) for _, lang, ws in rows]) if rows else None


def identify(docs: DataFrame, model: tuple[ByteCNN, list[str]] | None) -> DataFrame:
    """``docs`` with lang_pred and score for every row; columns of these names are replaced.

    Texts of any length are read whole, a bounded number of bytes at a time.  ``und`` with score 0 for a null text, a text without letters, or where there was nothing to
    learn from."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, at):
                texts = part.column(at).to_pylist()
                able = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if able:
                    net, langs = model
                    x, count = windows([texts[i].encode("utf-8", "replace") for i in able])
                    p = softmax(net.logits(net.features(x)).astype(np.float64))
                    mean = np.add.reduceat(p, np.cumsum(count) - count, axis=0) / count[:, None]
                    for i, best, m in zip(able, mean.argmax(1), mean, strict=True):
                        lang[i], score[i] = langs[best], float(min(1.0, m[best]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op4_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document of ``documents``.

    ``und`` for null texts and texts without letters; repeated rows get equal predictions; an empty
    table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    named = identify(docs.select("doc_id", "text"), fit(docs))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
