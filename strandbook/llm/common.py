"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, in a local test, a temporary folder takes its place; on a cluster its
    executors would not see that folder, so there the setting is required."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="strandbook-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are kept in the shared folder and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts hold 1,000 rows instead of Spark's 10,000, unless the session says otherwise:
    a batch stands in the memory of the JVM and of its Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def few_ids(ids: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` of the distinct values of ``ids`` (doc_id), evenly drawn by their hashes.

    The hashes below a limit that lets about twice the bound through are the only ones sorted, so
    no task sees more of them as the table grows."""
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    share = min(1.0, 2 * bound / max(1, ids.count()))
    return ids.where(key <= (int(share * (1 << 53)) << 10) - 1).distinct().orderBy(key, "doc_id").limit(bound)


def few_by(rows: DataFrame, group: str, bound: int) -> DataFrame:
    """At most ``bound`` doc_ids of ``rows`` (doc_id, group), drawn by hash: an equal share of each group.

    Groups are few (labels).  Only hashes below a limit of each group are ranked."""
    counts = rows.groupBy(group).count()
    share = max(1, bound // max(1, counts.count()))
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    least = (F.least(F.lit(1.0), 2 * share / F.col("count")) * float((1 << 63) - 1024)).cast("long")
    drawn = rows.join(F.broadcast(counts.select(group, least.alias("least"))), group).where(key <= F.col("least")).select("doc_id", group).distinct()
    ranked = drawn.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy(key, "doc_id"))).where(F.col("n") <= share)
    return ranked.select("doc_id").distinct()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """Rows of a batch, a few at a time as Python objects."""
    for lo in range(0, batch.num_rows, step):
        yield from zip(*(c.slice(lo, step).to_pylist() for c in batch.columns), strict=True)


def parts_of(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose binary or string ``column`` has about ``most`` bytes, a row at least."""
    import pyarrow.compute as pc

    size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < batch.num_rows:
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(size.searchsorted(before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
