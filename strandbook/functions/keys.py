"""Names of streams, commits, chunks and key generations, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION_DIGITS, GENERATION_DIGITS = 12, 6


def padded(n: Column, digits: int) -> Column:
    """``n`` with leading zeros; negative numbers, and those with more digits, fail instead of being cut."""
    fits = (n >= 0) & (n < F.lit(10**digits))
    return F.when(n.isNotNull(), F.when(fits, F.lpad(n.cast("string"), digits, "0")).otherwise(F.raise_error(F.concat(F.lit("number out of range: "), n.cast("string")))))


def pad_version(version: Column) -> Column:
    return padded(version, VERSION_DIGITS)


def generation_id(generation: Column) -> Column:
    return padded(generation, GENERATION_DIGITS)


def generation_of(key_id: Column) -> Column:
    return F.when(key_id.rlike(r"^\d{6}$"), key_id.cast("long"))


def valid_stream_id(stream_id: Column, reserved: bool = False) -> Column:
    """Not empty, without a slash; names that begin with ``$`` only where they are allowed."""
    good = (F.length(stream_id) > 0) & ~F.contains(stream_id, F.lit("/"))
    return F.coalesce(good if reserved else good & ~F.startswith(stream_id, F.lit("$")), F.lit(False))


def stream_path(prefix: str, stream_id: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), F.lit("streams"), stream_id)


def commit_path(prefix: str, stream_id: Column, base: Column) -> Column:
    return F.concat(stream_path(prefix, stream_id), F.lit("/e/"), pad_version(base), F.lit(".json"))


def chunk_path(prefix: str, stream_id: Column, base: Column) -> Column:
    return F.concat(stream_path(prefix, stream_id), F.lit("/c/"), pad_version(base), F.lit(".json"))


def head_path(prefix: str, stream_id: Column) -> Column:
    return F.concat(stream_path(prefix, stream_id), F.lit("/head.json"))


def generation_path(subject: Column, generation: Column) -> Column:
    return F.concat(F.lit("keys/"), subject, F.lit("/"), generation_id(generation), F.lit(".json"))


def tombstone_path(subject: Column) -> Column:
    return F.concat(F.lit("tombstones/"), subject, F.lit(".json"))


def key_of(path: Column) -> Column:
    """Struct (subject, key_id) of a key's path, null for any other path."""
    whole = r"^keys/(.+)/([0-9]{6})\.json$"
    return F.when(path.rlike(whole), F.struct(F.regexp_extract(path, whole, 1).alias("subject"), F.regexp_extract(path, whole, 2).alias("key_id")))


def base_of(path: Column) -> Column:
    """The version in the last part of a commit's or chunk's path; null for any other path."""
    digits = F.regexp_extract(path, r"(?:^|/)([0-9]{12})\.json$", 1)
    return F.when(digits != "", digits.cast("long"))


def bucket_base(base: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return base - F.pmod(base, n)


def canonical_from(start: Column, size: int) -> Column:
    """The first version of the page that holds ``start``; 0 for what is no positive finite number."""
    x = start.cast("double")
    bad = x.isNull() | F.isnan(x) | (x == float("inf")) | (x <= 0)
    return F.when(bad, F.lit(0).cast("long")).otherwise((F.floor(x / size) * size).cast("long"))


def valid_expected(kind: Column, version: Column) -> Column:
    """``any``, ``noStream``, or ``version`` with a number from 0."""
    return F.coalesce(kind.isin("any", "noStream") | ((kind == "version") & (version >= 0)), F.lit(False))
