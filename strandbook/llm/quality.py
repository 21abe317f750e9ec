"""Quality classification by a byte convolutional network over overlapping chunks.

The chunks cover the whole document; each filter's response is max-pooled inside a chunk, and the
largest and the mean response over all chunks are combined by a logistic unit into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN
from .common import few_ids, held_out, parts_of, small_batches, table

CHUNK, OVERLAP = 512, 64
THRESHOLD = 0.7
SAMPLE_DOCS = 3_000  # bound of the labelled rows that the classifier learns from
SAMPLE_CHUNKS = 6  # chunks of each of them, spread over the text
EPOCHS, BATCH, RATE = 6, 32, 0.01
STEPS = 400  # steps of training at least, so a small sample is gone over more often


def chunks(text: bytes) -> np.ndarray:
    """Overlapping rows of CHUNK bytes that cover the text; the last ends with it."""
    x = np.frombuffer(text.ljust(CHUNK, b"\0"), dtype=np.uint8)
    last = len(x) - CHUNK
    starts = np.append(np.arange(0, last, CHUNK - OVERLAP), last)
    return np.lib.stride_tricks.sliding_window_view(x, CHUNK)[starts]


def pooled(z: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Features of chunks -> largest and mean over each document's chunks."""
    first = np.cumsum(count) - count
    return np.concatenate([np.maximum.reduceat(z, first, axis=0), np.add.reduceat(z, first, axis=0) / count[:, None]], axis=1)


def probability(net: ByteCNN, h: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.logits(h)[:, 0].astype(np.float64), -30, 30)))


def train(samples: list[tuple[int, np.ndarray]], seed: int = 0) -> ByteCNN:
    """(label, chunks) of each document -> network."""
    net = ByteCNN(1, head_inputs=2, seed=seed)
    rng, state = np.random.default_rng(seed), {}
    epochs = max(EPOCHS, -(-STEPS // -(-len(samples) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for lo in range(0, len(order), BATCH):
            part = [samples[i] for i in order[lo : lo + BATCH]]
            x, y = np.concatenate([c for _, c in part]), np.array([label for label, _ in part])
            count = np.array([len(c) for _, c in part])
            first, doc = np.cumsum(count) - count, np.repeat(np.arange(len(part)), count)
            z, where = net.forward(x)
            h = pooled(z, count)
            d = ((probability(net, h) - y) / len(part)).astype(np.float32)[:, None]
            dh = d @ net.p["head"].T
            n = z.shape[1]
            # the largest response's gradient goes to the first chunk that has it
            top = z == h[doc, :n]
            lead = np.cumsum(top, axis=0)
            before = np.where((first > 0)[:, None], lead[np.maximum(first - 1, 0)], 0)
            top &= lead - before[doc] == 1
            dz = top * dh[doc, :n] + (dh[:, n:] / count[:, None])[doc]
            g = net.gradients(x, z, where, dz)
            net.adam(g | {"head": h.T @ d, "out": d.sum(0)}, state, RATE / (1 + 0.5 * epoch * EPOCHS / epochs))
    return net


def fit(docs: DataFrame, labels: DataFrame) -> ByteCNN | None:
    """Learns labels.quality from the texts of at most SAMPLE_DOCS documents that are not held out.

    A repeated doc_id is learned once, with the greatest of its labels and the least of its texts."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    few = known.join(F.broadcast(few_ids(known.select("doc_id"), SAMPLE_DOCS)), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    least = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    texts = least.select("doc_id", "quality", F.encode("text", "UTF-8").alias("bytes"))
    step = F.greatest(F.length("bytes") - CHUNK, F.lit(0)) / F.lit(SAMPLE_CHUNKS - 1)
    picked = [F.substring("bytes", (F.lit(1) + F.floor(step * i)).cast("int"), F.lit(CHUNK)) for i in range(SAMPLE_CHUNKS)]
    rows = texts.select("doc_id", "quality", F.array_distinct(F.array(*picked)).alias("chunks")).collect()
    rows = sorted((r["doc_id"], r["quality"], [bytes(c) for c in r["chunks"]]) for r in rows)
    return train([(label, np.concatenate([chunks(c) for c in cs])) for _, label, cs in rows]) if rows else None


def score(docs: DataFrame, net: ByteCNN | None) -> DataFrame:
    """doc_id, score of every row of ``docs``: the probability that its quality label is 1.

    Null texts are empty; an empty text is one chunk of zeros.  Without labels every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1):
                if net is None:
                    found = np.full(part.num_rows, 0.5)
                else:
                    each = [chunks((t or "").encode("utf-8", "replace")) for t in part.column(1).to_pylist()]
                    count = np.array([len(c) for c in each])
                    found = probability(net, pooled(net.features(np.concatenate(each)), count))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op8_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document of ``documents``.

    Null texts are scored as empty ones; repeated rows get equal scores; an empty table gives no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
