"""Binary token files with one zstandard dictionary for all documents.

A file set is a folder with two Parquet tables, so that any store that Spark reaches can hold it:

``dictionary``  one row: the dictionary trained on serialised id arrays, and its SHA-256.
``segments``    one row for about a megabyte of documents in ascending doc_id: ``number`` and
                ``part`` (order of segments), ``first_doc``/``last_doc``, the dictionary's hash, the
                number of ids before the segment in its part, how many of its first documents have no doc_id, and
                two binary columns:

* ``frames``: one zstandard frame for each document, one after the other; a frame holds the
  document's ids as little-endian unsigned 16-bit (vocabulary under 65,536) or 32-bit integers;
* ``offsets``: for each document the int64 triple (doc_id, end of its frame in bytes, ids so far),
  little-endian.  One document is found by its range of doc_ids and read by its own frame alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few_ids, partitions, parts_of, shared_dir, small_batches, table
from .tokens import Encoder, vocabulary

END_ID = 2
SAMPLE_DOCS = 512  # documents (by smallest hash of doc_id) on which the dictionary is trained
DICTIONARY_BYTES = 65_536
SEGMENT_BYTES = 1 << 20
LEVEL = 3

SEGMENT = "part int, number int, first_doc long, last_doc long, dictionary_sha256 string, ids_before long, n_ids long, width int, without int, offsets binary, frames binary"


def serialise(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """The dictionary; empty where there is too little to learn from (frames then stand alone)."""
    import zstandard

    while size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            size //= 4
    return b""


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            out = [serialise(np.append(ids, np.uint32(end_id)), 2 if len(encoder.ends) < 65_536 else 4) for ids in encoder.encode([t or "" for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return run


def _segments(path: str, end_id: int, dictionary: bytes, sha: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        width = 2 if len(encoder.ends) < 65_536 else 4
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=False)
        number, before, index, frames, size, inside, without = 0, 0, [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            offsets = np.array(index, dtype="<i8")
            row = [part, number, index[0][0], index[-1][0], sha, before, inside, width, without, offsets.tobytes(), b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SEGMENT.split(", ")])

        for part_of_batch in (p for batch in batches for p in parts_of(batch, 1)):
            for doc_id, ids in zip(part_of_batch.column(0).to_pylist(), encoder.encode([t or "" for t in part_of_batch.column(1).to_pylist()]), strict=True):
                frame = press.compress(serialise(np.append(ids, np.uint32(end_id)), width))
                frames.append(frame)
                size, inside = size + len(frame), inside + len(ids) + 1
                without += doc_id is None
                index.append((0 if doc_id is None else doc_id, size, inside))
                if size >= SEGMENT_BYTES:
                    yield closed()
                    number, before, index, frames, size, inside, without = number + 1, before + inside, [], [], 0, 0, 0
        if index:
            yield closed()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes ``docs`` (doc_id, text) as a file set in ascending doc_id order; gives the folder.

    Null texts are empty.  Rows without doc_id come first.  Rows of equal doc_id follow each other in the
    order of a hash of their texts, by which a frequent id is spread over tasks.  Other columns are
    ignored; an empty table gives a file set without segments.

    The dictionary is trained on the least texts of at most SAMPLE_DOCS documents."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    few = few_ids(texts.where("doc_id IS NOT NULL").select("doc_id"), SAMPLE_DOCS)
    least = texts.join(F.broadcast(few), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = least.select("text").mapInArrow(_encode(path, end_id), "ids binary")
    content = train(sorted(bytes(r["ids"]) for r in sample.collect()))
    sha = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(bytearray(content), sha)], "content binary, dictionary_sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")
    keyed = texts.withColumn("order", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "order").sortWithinPartitions("doc_id", "order", "text").select("doc_id", "text")
    ordered.mapInArrow(_segments(path, end_id, content, sha), SEGMENT).write.option("compression", "none").parquet(f"{folder}/segments")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary, unsigned 32-bit)."""
    kept = spark.read.parquet(f"{folder}/dictionary").first()
    content, sha = bytes(kept["content"]), kept["dictionary_sha256"]
    if hashlib.sha256(content).hexdigest() != sha:
        raise ValueError("the dictionary differs from its hash")
    segments = spark.read.parquet(f"{folder}/segments")
    # one row for each part, as many as the writing tasks
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError("a segment was written with another dictionary")
                index = np.frombuffer(row["offsets"], dtype="<i8").reshape(-1, 3)
                frames, at, before = memoryview(row["frames"]), 0, 0
                out = []
                for _, end, upto in index.tolist():
                    ids = np.frombuffer(expand.decompress(frames[at:end]), dtype="<u2" if row["width"] == 2 else "<u4").astype("<u4")
                    if len(ids) != upto - before:
                        raise ValueError("a frame differs from its index")
                    out.append(ids.tobytes())
                    at, before = end, upto
                start = row["part_start"] + row["ids_before"] + np.concatenate([[0], index[:-1, 2]])
                n = np.diff(index[:, 2], prepend=0)
                named = pa.array(index[:, 0], mask=np.arange(len(index)) < row["without"])
                yield pa.RecordBatch.from_arrays([named, pa.array(start), pa.array(n), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.join(parts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op9_dictionary_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` as read back from files written in the shared folder.

    Null and empty texts have the end id alone; an empty table gives no rows."""
    folder = write(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/id-files-{uuid.uuid4().hex}")
    rows = read(spark, folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
