"""Column expressions on records: expiry, sizes, checksums, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_KEY, MAX_TTL, MAX_VALUE, RECORD_EXPIRY, RECORD_FIXED


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, rounded down; the session's time zone plays no part."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("epoch_ms takes a column name")
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name}) div 1000")


def expiry_of(ts_ms: Column, ttl_s: Column) -> Column:
    """Absolute expiry; 0 or no seconds mean none."""
    return F.when(ttl_s > 0, ts_ms + ttl_s * 1000)


def unexpired(expiry_ms: Column, as_of_ms: Column | int) -> Column:
    """An expiry equal to the instant has passed."""
    return F.coalesce(expiry_ms > as_of_ms, F.lit(True))


def record_size(key: Column, value: Column, expiry_ms: Column) -> Column:
    return F.lit(RECORD_FIXED) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + F.when(expiry_ms.isNotNull(), RECORD_EXPIRY).otherwise(0)


def memory_size(key: Column, value: Column, expiry_ms: Column) -> Column:
    return record_size(key, value, expiry_ms) - RECORD_FIXED


def checksum(key: Column, value: Column) -> Column:
    """IEEE CRC-32 of key and value bytes."""
    return F.crc32(F.encode(F.concat(key, F.coalesce(value, F.lit(""))), "UTF-8"))


#: What fault() may say.
FAULTS = ("empty key", "key too large", "value too large", "ttl out of range")


def fault(key: Column, value: Column, ttl_s: Column) -> Column:
    """What forbids a write, or null. The same limits hold in every mode."""
    return (
        F.when(key.isNull() | (key == ""), F.lit(FAULTS[0]))
        .when(F.octet_length(key) > MAX_KEY, F.lit(FAULTS[1]))
        .when(F.octet_length(value) > MAX_VALUE, F.lit(FAULTS[2]))
        .when((ttl_s < 0) | (ttl_s > MAX_TTL), F.lit(FAULTS[3]))
    )
