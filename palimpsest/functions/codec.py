"""The version schema, key encoding, sizes and predicates.

A version is ``(raw_key, commit_ts, value, seq)``. An empty value is a tombstone. Keys are binary or string; both
compare by unsigned bytes. ``seq`` orders versions of one key and timestamp: the greater is the later write.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

VERSION_SCHEMA = T.StructType([
    T.StructField("raw_key", T.BinaryType(), False),
    T.StructField("commit_ts", T.LongType(), False),
    T.StructField("value", T.BinaryType(), False),
    T.StructField("seq", T.IntegerType(), False),
])
STAGED_SCHEMA = T.StructType([
    T.StructField("raw_key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), False),
    T.StructField("kind", T.ByteType(), False),
    T.StructField("seq", T.IntegerType(), False),
])
PUT, DELETE = 1, 2
TIMESTAMP_BYTES = 8


class InvalidRange(ValueError):
    """The start of a range is above its end."""


def key_range(start, end) -> tuple:
    """An inclusive range of keys; raises InvalidRange if start > end."""
    if start > end:
        raise InvalidRange(f"start {start!r} is above end {end!r}")
    return start, end


def valid_key(key: bytes) -> bytes:
    if not key:
        raise ValueError("a key must not be empty")
    return bytes(key)


def in_range(key: Column, start, end) -> Column:
    """start <= key <= end, in a form that is pushed down to scans."""
    start, end = key_range(start, end)
    return key.between(F.lit(start), F.lit(end))


def visible(at: int) -> Column:
    return F.col("commit_ts") <= at


def is_tombstone(value: Column) -> Column:
    return F.length(value) == 0


def encode_key(raw_key: Column, commit_ts: Column) -> Column:
    """raw key bytes, then the timestamp as 8 bytes, little-endian."""
    digits = F.lpad(F.hex(commit_ts), 16, "0")
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)]
    return F.concat(raw_key.cast("binary"), F.unhex(F.concat(*pairs)))


def decode_key(encoded: Column) -> Column:
    """struct(raw_key, commit_ts) of an encoded key."""
    n = F.length(encoded) - TIMESTAMP_BYTES
    tail = F.hex(F.substring(encoded, n + 1, F.lit(TIMESTAMP_BYTES)))
    swapped = F.concat(*[F.substring(tail, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.struct(F.substring(encoded, F.lit(1), n).alias("raw_key"), F.conv(swapped, 16, 10).cast("long").alias("commit_ts"))


def encoded_size(raw_key: Column) -> Column:
    return F.octet_length(raw_key) + TIMESTAMP_BYTES


def entry_size(raw_key: Column | None = None, value: Column | None = None) -> Column:
    """Bytes of a version: key, timestamp and value."""
    key = F.col("raw_key") if raw_key is None else raw_key
    return encoded_size(key) + F.octet_length(F.col("value") if value is None else value)


def hash_functions(false_positives: float) -> int:
    return math.ceil(math.log2(1 / false_positives))


def bloom_bits(n: Column, false_positives: float = 0.01) -> Column:
    return F.floor(n * abs(math.log(false_positives)) / math.log(2) ** 2).cast("long")


def typed(versions: DataFrame, schema: str) -> DataFrame:
    """``versions`` with the value parsed from JSON into ``v``; an extension above the store."""
    return versions.withColumn("v", F.from_json(F.col("value").cast("string"), schema))
