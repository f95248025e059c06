"""Names of chunks, as column expressions that run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def chunk_id(data: Column) -> Column:
    """Lower-case hex SHA-256 of the plain bytes."""
    return F.sha2(data, 256)


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256 for a key."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def chunk_id_keyed(data: Column, inner: Column, outer: Column) -> Column:
    """Hex HMAC-SHA256 of the plain bytes. The pads are columns, so that a key need not stand in the plan."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)


def shard(chunk: Column, width: int = 2) -> Column:
    return F.substring(chunk, 1, width)


def chunk_key(chunk: Column) -> Column:
    """Flat object key of a chunk."""
    return F.concat(F.lit("chunks/"), shard(chunk), F.lit("/"), chunk)


def snapshot_key(snapshot: Column) -> Column:
    return F.concat(F.lit("snapshots/"), snapshot, F.lit(".json"))


def snapshot_id_of(key: Column) -> Column:
    """The id in a key directly under snapshots/ that ends in .json; null for any other key."""
    return F.when(key.rlike(r"^snapshots/[^/]+\.json$"), F.substring_index(F.substring_index(key, "/", -1), ".json", 1))


def snapshot_time(snapshot: Column) -> Column:
    return F.try_to_timestamp(F.substring(snapshot, 1, 16), F.lit("yyyyMMdd'T'HHmmss'Z'"))
