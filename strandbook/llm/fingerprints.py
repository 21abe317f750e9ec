"""Document fingerprints: a Merkle tree over sections, paragraphs and their phrases.

A text is cut into paragraphs at line ends.  A blank line, or a paragraph whose own hash ends in
three zero bits, closes a section, so sections begin and end by content and an insertion moves no
later border.  Inside a paragraph the leaves are phrases: at most PHRASE_WORDS words of a sentence,
or single words of a short sentence.

* leaf = 32-bit hash of the phrase
* paragraph = hash of its leaves; section = hash of its paragraphs; root = hash of the sections and
  of the text itself, so that roots are equal exactly for equal texts

A fingerprint is a string of these: ``root/section:paragraph,leaf,leaf;paragraph,.../section:...``.
Equal roots mean equal texts; where roots differ, equal sections and paragraphs are skipped and the
differing branches tell where the texts differ (``differing``).  ``likeness`` is the share of common
leaves, twice their number over the number in both, computed from two fingerprints alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small_batches, table

PHRASE_WORDS = 4
SHORT_SENTENCE = 8  # words; shorter sentences have one leaf for each word
SENTENCE = re.compile(r"[^.!?;|]*[.!?;|]*\s*")
PHRASE = re.compile(rf"\S+(?:\s+\S+){{0,{PHRASE_WORDS - 1}}}")

Tree = tuple[str, list[tuple[int, list[tuple[int, list[int]]]]]]


def _phrases(sentence: str) -> list[str]:
    words = sentence.split()
    return words if len(words) <= SHORT_SENTENCE else PHRASE.findall(sentence)


def _hash(children: list[int]) -> int:
    return zlib.crc32(b"".join(c.to_bytes(4, "little") for c in children))


def tree(text: str) -> Tree:
    """(root, [(section, [(paragraph, leaves)])])"""
    sections, open_section = [], []

    def close() -> None:
        if open_section:
            sections.append((_hash([p for p, _ in open_section]), list(open_section)))
            open_section.clear()

    for line in text.split("\n"):
        leaves = [zlib.crc32(p.encode("utf-8", "surrogatepass")) for s in SENTENCE.findall(line) for p in _phrases(s)]
        if not leaves:
            close()
            continue
        paragraph = _hash(leaves)
        open_section.append((paragraph, leaves))
        if paragraph % 8 == 0:
            close()
    close()
    root = hashlib.blake2b(digest_size=16)
    root.update(b"".join(s.to_bytes(4, "little") for s, _ in sections))
    root.update(text.encode("utf-8", "surrogatepass"))
    return root.hexdigest(), sections


def encode(t: Tree) -> str:
    root, sections = t
    return "/".join([root, *(f"{s:08x}:" + ";".join(",".join([f"{p:08x}", *(f"{x:08x}" for x in leaves)]) for p, leaves in paragraphs) for s, paragraphs in sections)])


def decode(fingerprint: str) -> Tree:
    root, *sections = fingerprint.split("/")
    out = []
    for s in sections:
        name, _, rest = s.partition(":")
        out.append((int(name, 16), [(int(p[0], 16), [int(x, 16) for x in p[1:]]) for p in (q.split(",") for q in rest.split(";"))]))
    return root, out


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots, otherwise twice the common leaves over all leaves (0 where there are none)."""
    if a[0] == b[0]:
        return 1.0
    x, y = ([leaf for _, paragraphs in t[1] for _, leaves in paragraphs for leaf in leaves] for t in (a, b))
    if not x or not y:
        return 0.0
    count = Counter(x)
    common = 0
    for leaf in y:
        if count.get(leaf, 0) > 0:
            count[leaf] -= 1
            common += 1
    return 2 * common / (len(x) + len(y))


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``a`` that ``b`` doesn't hold; equal branches are not entered."""
    if a[0] == b[0]:
        return []
    whole, parts = {s for s, _ in b[1]}, {p for _, paragraphs in b[1] for p, _ in paragraphs}
    return [(i, j) for i, (s, paragraphs) in enumerate(a[1]) if s not in whole for j, (p, _) in enumerate(paragraphs) if p not in parts]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections int, n_differing int"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and in order; each range ends with the first row of the next one."""
    previous, held = None, None
    out: list[tuple] = []
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in OUT.split(", ")]

    def full() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    size = 0
    for batch in batches:
        for span, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if span != previous:
                previous, held = span, None
            if held is not None or not ahead:
                here = tree(text)
                if held is not None:
                    last_id, last_text, last = held
                    new = edited(last_text, text)
                    new_tree = tree(new)
                    row = (last_id, len(last_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(last), encode(new_tree))
                    out.append((*row, likeness(last, new_tree), likeness(last, here), len(last[1]), len(differing(last, new_tree))))
                    size += len(last_text)
                held = None if ahead else (doc_id, text, here)
            if size > 4_000_000:
                yield full()
                size = 0
    yield full()


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> one row for each row, with the fingerprint of its text and of its edit.

    The following document is the one with the next doc_id; the first follows the last.  Null texts
    are empty.  Rows without doc_id come first; rows of equal doc_id follow each other in the order
    of their texts.  Other columns are ignored; an empty table gives an empty result.

    The ids are cut into ranges at ids of the table.  A range also gets the rows of the id that the
    next one begins with, so the following document is always at hand in one sorted pass."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = ranges or partitions(spark)
    low = -(1 << 63)
    at = F.coalesce("doc_id", F.lit(low))
    found = texts.select(F.min(at).alias("low"), F.percentile_approx(at, [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts")).first()
    if found["low"] is None:
        return spark.createDataFrame([], OUT)
    starts = np.array(sorted({found["low"], *found["cuts"]}), dtype=np.int64)  # as many as partitions at most

    @F.pandas_udf("struct<span: int, begins: boolean>")
    def placed(ids: pd.Series) -> pd.DataFrame:
        x = ids.to_numpy()
        span = np.searchsorted(starts, x, side="right") - 1
        return pd.DataFrame({"span": span.astype(np.int32), "begins": starts[span] == x})

    texts = texts.withColumn("at", placed(at))
    span, begins = F.col("at.span"), F.col("at.begins")
    before = F.pmod(span - 1, F.lit(len(starts)))
    dealt = texts.withColumn("to", F.when(begins, F.array(F.struct(span.alias("span"), F.lit(False).alias("ahead")), F.struct(before.alias("span"), F.lit(True).alias("ahead")))).otherwise(F.array(F.struct(span.alias("span"), F.lit(False).alias("ahead")))))
    dealt = dealt.select(F.explode("to").alias("to"), "doc_id", "text").select("to.span", "to.ahead", "doc_id", "text")
    ordered = dealt.repartitionByRange(n, "span").sortWithinPartitions("span", "ahead", "doc_id", "text")
    return ordered.mapInArrow(_rows, OUT)


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its fingerprint, that of its edited text, and likenesses.

    Null texts are empty, an empty text has a root alone, and an empty table gives no rows."""
    return fingerprints(table(spark, sf_dir, "documents"))
