"""Encryption of whole payloads and of single fields.

Keys are columns that come from a joined table, never literals, so no plan shows them.  An
encrypted payload is base64 of nonce, ciphertext and tag (AES-256-GCM) over one header byte and the
JSON text; the header tells whether the text is compressed.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: fixed values: header bytes and the shape of a field whose key is gone
RAW, COMPRESSED = "00", "01"
SHREDDED = '{"$shredded":true}'


def payload_aad(stream_id: Column, key_id: Column) -> Column:
    return F.concat(stream_id, F.lit("\n"), key_id)


def field_aad(stream_id: Column, key_id: Column, field: str | Column) -> Column:
    return F.concat(payload_aad(stream_id, key_id), F.lit("\n"), F.lit(field) if isinstance(field, str) else field)


@F.pandas_udf(BinaryType())
def _gzip(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8"), mtime=0))


@F.pandas_udf(StringType())
def _gunzip(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else zlib.decompress(bytes(d), 31).decode("utf-8"))


def encrypt(text: Column, key: Column, aad: Column, compress: bool = False) -> Column:
    """Without an explicit nonce Spark draws one.  A null text is JSON null."""
    text = F.coalesce(text, F.lit("null"))
    body = F.concat(F.unhex(F.lit(COMPRESSED)), _gzip(text)) if compress else F.concat(F.unhex(F.lit(RAW)), F.encode(text, "UTF-8"))
    return F.translate(F.base64(F.aes_encrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad)), "\r\n", "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def decrypt(data: Column, key: Column, aad: Column, compressed: bool = True) -> Column:
    """Null for a wrong key, AAD or altered data, and for a header that is neither raw nor compressed.

    The header alone tells whether a payload is compressed.  ``compressed=False`` promises that none is
    and keeps all work in the JVM; a payload that breaks the promise fails."""
    plain = _opened(data, key, aad)
    # a Python function can't stand in a lambda
    return _text_of(plain, True) if compressed else _once(plain, lambda p: _text_of(p, False))


def _opened(data: Column, key: Column, aad: Column) -> Column:
    return F.try_aes_decrypt(F.unbase64(data), key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def _text_of(plain: Column, compressed: bool) -> Column:
    body = F.substring(plain, F.lit(2), F.octet_length(plain))
    raw = F.decode(body, "UTF-8")
    header = F.hex(F.substring(plain, 1, 1))
    if not compressed:
        broken = F.raise_error(F.lit("a compressed payload where none was announced")).cast("string")
        return F.when(header == RAW, raw).when(header == COMPRESSED, broken)
    return F.when(header == COMPRESSED, _gunzip(F.when(header == COMPRESSED, body))).when(header == RAW, raw)


def encrypt_payloads(log: DataFrame, keys: DataFrame, compress: bool = False) -> DataFrame:
    """``keys`` (stream_id, key_id, key): streams with a key get an encrypted ``data`` and a key_id;
    streams without one, and those whose name begins with ``$``, stay plain."""
    open_ = log.join(keys.where(~F.startswith("stream_id", F.lit("$"))), "stream_id", "left")
    secret = encrypt(F.col("data"), F.col("key"), payload_aad(F.col("stream_id"), F.col("key_id")), compress)
    return open_.withColumn("data", F.when(F.col("key").isNotNull(), secret).otherwise(F.col("data"))).drop("key")


def decrypt_payloads(log: DataFrame, keyring: DataFrame, compressed: bool = True, strict: bool = True) -> DataFrame:
    """``keyring`` (stream_id, key_id, key).  Adds status: plain, ok, shredded (no key) or corrupt.

    Strict reading fails on altered data; a shredded payload is null."""
    met = log.join(keyring, ["stream_id", "key_id"], "left")
    # a column of its own, so that each payload is opened once and not wherever its header or text is asked for
    met = met.withColumn("opened", _opened(F.col("data"), F.col("key"), payload_aad(F.col("stream_id"), F.col("key_id"))))
    met = met.withColumn("plain", _text_of(F.col("opened"), compressed)).drop("opened")
    status = F.when(F.col("key_id").isNull(), "plain").when(F.col("key").isNull(), "shredded").when(F.col("plain").isNotNull(), "ok").otherwise("corrupt")
    met = met.withColumn("status", status)
    bad = F.raise_error(F.concat(F.lit("payload fails authentication in "), F.col("stream_id"))).cast("string")
    data = F.when(F.col("status") == "plain", F.col("data")).when(F.col("status") == "corrupt", bad if strict else F.lit(None).cast("string")).otherwise(F.col("plain"))
    return met.withColumn("data", data).drop("plain", "key")


def _kind(value: Column, key: str | None = None) -> Column:
    """The type name of a variant, or of its field ``key``."""
    inner = value if key is None else F.try_variant_get(value, f"$['{key}']", "variant")
    return F.coalesce(F.schema_of_variant(inner), F.lit("VOID"))


def is_envelope(value: Column) -> Column:
    """A variant that is an object whose ``$enc`` is a string."""
    return _kind(value, "$enc") == "STRING"


def is_shredded(value: Column) -> Column:
    """A variant that is an object whose ``$shredded`` is true."""
    return (_kind(value, "$shredded") == "BOOLEAN") & F.coalesce(F.try_variant_get(value, "$['$shredded']", "boolean"), F.lit(False))


def is_field_envelope(field: Column) -> Column:
    """JSON text of a field that holds an encrypted value."""
    return is_envelope(F.try_parse_json(field))


def is_shredded_field(field: Column) -> Column:
    return is_shredded(F.try_parse_json(field))


def is_object(data: Column) -> Column:
    """JSON text of an object."""
    return _kind(F.try_parse_json(data)).startswith("OBJECT")


def entries(data: Column) -> Column:
    """The top-level fields of an object's JSON text, in their order, as a map of variants."""
    return F.when(is_object(data), F.from_json(data, "map<string,variant>"))


def encrypt_field(value: Column, key: Column, key_id: Column, stream_id: Column, field: str | Column) -> Column:
    """``value`` is the field's JSON text; the result is the JSON text of its envelope, which holds the
    ciphertext alone: the event carries the key id.  An absent field (null) stays absent."""
    secret = encrypt(value, key, field_aad(stream_id, key_id, field))
    return F.when(value.isNotNull(), F.concat(F.lit('{"$enc":"'), secret, F.lit('"}')))


def decrypt_field(value: Column, key: Column, key_id: Column, stream_id: Column, field: str | Column, compressed: bool = True) -> Column:
    """Plain fields stay; envelopes without a key become the shredded marker; altered ones fail."""
    name = F.lit(field) if isinstance(field, str) else field
    text = decrypt(F.get_json_object(value, "$['$enc']"), key, field_aad(stream_id, key_id, field), compressed)
    bad = F.raise_error(F.concat(F.lit("field fails authentication: "), name)).cast("string")
    return F.when(~F.coalesce(is_field_envelope(value), F.lit(False)), value).when(key.isNull(), F.lit(SHREDDED)).otherwise(F.coalesce(text, bad))


Subject = Callable[[Column, Column], Column]


def subject_in(field: str) -> Subject:
    """The subject of an event, found by (type, data): a top-level string field of its data."""
    return lambda _type, data: F.get_json_object(data, f"$['{field}']")


def _marked(data: Column, fields: Column) -> Column:
    """``data`` with an empty envelope in place of each of ``fields`` that it has."""
    marker = F.parse_json(F.lit('{"$enc":{}}'))
    return F.to_json(F.transform_values(entries(data), lambda k, v: F.when(F.array_contains(fields, k), marker).otherwise(v)))


def gated(events: DataFrame, annotations: DataFrame, subject: Subject) -> DataFrame:
    """``events`` (stream_id, type, data, ...) with fields, subject and reason.

    ``annotations`` (type, fields, plaintext): the top-level fields to encrypt of each type, or
    plaintext = true.  ``reason`` tells why an event must not be written, or is null; it is worked out of
    the payload, the annotation and the subject before any key is asked for.  Streams whose name begins
    with ``$`` and plaintext types pass with fields null."""
    # a row for each type, of which there are few; dealt by type the log would have no more tasks than types
    notes = annotations.select("type", F.col("fields").alias("fields"), F.coalesce("plaintext", F.lit(False)).alias("plaintext"), F.lit(True).alias("known"))
    met = events.join(F.broadcast(notes), "type", "left")
    fields = F.coalesce("fields", F.array().cast("array<string>"))
    open_ = F.startswith("stream_id", F.lit("$")) | F.coalesce("plaintext", F.lit(False))
    met = met.withColumn("subject", F.when(~open_, subject(F.col("type"), F.col("data"))))
    reserved = F.exists(F.map_entries(entries(F.col("data"))), lambda e: ~F.array_contains(fields, e["key"]) & (is_envelope(e["value"]) | is_shredded(e["value"])))
    # a subject that turns into an envelope is lost, whatever text it gives
    left = subject(F.col("type"), _marked(F.col("data"), fields))
    lost = _once(left, lambda x: ~x.eqNullSafe(F.col("subject")) | F.coalesce(F.contains(x, F.lit("$enc")), F.lit(False)))
    reason = (
        F.when(F.startswith("stream_id", F.lit("$")), None)
        .when(F.col("known").isNull(), "unannotated type")
        .when(F.col("plaintext"), None)
        .when(F.size(fields) == 0, "empty annotation")
        .when(F.col("subject").isNull(), "no subject")
        .when(~is_object(F.col("data")), "payload is no object")
        .when(F.exists(fields, lambda f: F.contains(f, F.lit("\n"))), "newline in field name")
        .when(reserved, "reserved shape")
        .when(lost, "subject is lost by encryption")
    )
    return met.withColumn("reason", reason.cast("string")).withColumn("fields", F.when(~open_, fields)).drop("plaintext", "known")


def encrypt_fields(passed: DataFrame, keys: DataFrame) -> DataFrame:
    """Events that passed the gates (``gated``, reason null) with their annotated fields encrypted under
    the current key of their subject and its key_id; ``keys``: subject, key_id, key.

    An event that needs a key whose subject has none (it was erased) fails."""
    met = passed.drop("key_id").join(keys.select("subject", "key_id", "key"), "subject", "left")
    secret = F.col("fields").isNotNull()
    gone = F.raise_error(F.concat(F.lit("subject was erased: "), F.col("subject"))).cast("binary")
    key = F.when(F.col("key").isNotNull(), F.col("key")).otherwise(gone)

    def closed(name: Column, value: Column) -> Column:
        return F.when(F.array_contains("fields", name), F.parse_json(encrypt_field(F.to_json(value), key, F.col("key_id"), F.col("stream_id"), name))).otherwise(value)

    data = F.when(secret, F.to_json(F.transform_values(entries(F.col("data")), closed))).otherwise(F.col("data"))
    return met.withColumn("data", data).withColumn("key_id", F.when(secret, F.col("key_id"))).drop("key", "fields", "reason", "subject")


def decrypt_fields(events: DataFrame, keys: DataFrame, subject: Subject) -> DataFrame:
    """Stored events with every field that holds an envelope decrypted, whatever annotations say now.

    ``keys`` (subject, key_id, key, status: ok, erased) has a row for each key that was asked for; fields
    of the erased become the shredded marker, and a key without a row fails.  Events without key_id stay.
    Fields were encrypted one by one and are not compressed."""
    met = events.withColumn("subject", F.when(F.col("key_id").isNotNull(), subject(F.col("type"), F.col("data"))))
    met = met.join(keys.select("subject", "key_id", "key", "status"), ["subject", "key_id"], "left")
    never = F.raise_error(F.concat(F.lit("key was never minted for "), F.coalesce("subject", F.lit("no subject")))).cast("string")
    found = F.filter(F.map_entries(entries(F.col("data"))), lambda e: is_envelope(e["value"]))

    def opened(name: Column, value: Column) -> Column:
        text = decrypt_field(F.to_json(value), F.col("key"), F.col("key_id"), F.col("stream_id"), name, compressed=False)
        return F.when(is_envelope(value), F.parse_json(text)).otherwise(value)

    data = F.to_json(F.transform_values(entries(F.col("data")), opened))
    data = F.when(F.col("key_id").isNull() | (F.size(found) < 1), F.col("data")).when(F.col("status").isNull(), never).otherwise(data)
    return met.withColumn("data", data).drop("key", "status", "subject")


def wrap(key: Column, master: Column, subject: Column, key_id: Column) -> Column:
    return F.aes_encrypt(key, master, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.concat_ws("/", subject, key_id))


def unwrap(wrapped: Column, master: Column, subject: Column, key_id: Column) -> Column:
    """Null under another master key or for a key grafted from another path."""
    return F.try_aes_decrypt(wrapped, master, F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws("/", subject, key_id))


def rewrap(keys: DataFrame) -> DataFrame:
    """``keys`` (subject, key_id, wrapped, old_master, new_master; moved, if there is such a column) with
    status and the wrapped form to keep.

    status: rewrapped, alreadyCurrent (an earlier run did it), skipped (the object is gone, wrapped is
    null, or it was moved under the writer: never written again blindly), failed (neither master opens
    it, or its path, and so subject and key_id, is no key's)."""
    moved = F.coalesce("moved", F.lit(False)) if "moved" in keys.columns else F.lit(False)
    ids = (F.col("subject"), F.col("key_id"))
    opened = keys.withColumn("by_old", unwrap(F.col("wrapped"), F.col("old_master"), *ids)).withColumn("by_new", unwrap(F.col("wrapped"), F.col("new_master"), *ids))
    status = F.when(F.col("wrapped").isNull(), "skipped").when(F.col("subject").isNull(), "failed").when(F.col("by_old").isNotNull() & moved, "skipped").when(F.col("by_old").isNotNull(), "rewrapped").when(F.col("by_new").isNotNull(), "alreadyCurrent").otherwise("failed")
    fresh = F.when(F.col("status") == "rewrapped", wrap(F.col("by_old"), F.col("new_master"), *ids)).otherwise(F.col("wrapped"))
    return opened.withColumn("status", status).withColumn("wrapped", fresh).drop("by_old", "by_new")
