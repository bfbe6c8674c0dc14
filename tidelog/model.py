"""Schemas and settings."""

from __future__ import annotations

import dataclasses

MUTATIONS = "seq long, ts_ms long, key string, value string, tombstone boolean, expiry_ms long"
COMMANDS = "seq long, ts_ms long, op string, key string, value string, ttl_s long, start string, end string"
MANIFEST = "segment_id long, path string, strategy string, level int, bucket int, created_seq long, min_key string, max_key string, n_records long, n_tombstones long, bytes long"

OPS = ("READ", "WRITE", "WRITETTL", "DELETE", "EXISTS", "LIST", "MGET", "MSET", "RANGE", "TTL", "COMPACT", "STATS", "PING")
#: Commands by their number, from 1.
CODES = ("READ", "WRITE", "DELETE", "COMPACT", "STATS", "LIST", "EXISTS", "PING", "MGET", "MSET", "RANGE", "TTL")
#: Limits of keys, values and relative expiry; bytes of a record's fixed part and of an expiry.
MAX_KEY, MAX_VALUE, MAX_TTL = 1 << 20, 5 << 20, (1 << 32) - 1
RECORD_FIXED, RECORD_EXPIRY = 21, 8


@dataclasses.dataclass(frozen=True)
class Settings:
    """mode "sorted" offers RANGE; "hash" answers it with an error."""

    mode: str = "sorted"
    strategy: str = "size_tiered"
    dead_ratio: float = 0.5
    max_segments: int = 10
    tier_low: float = 0.5
    tier_high: float = 1.5
    tier_files: int = 4
    level0_files: int = 4
    level1_bytes: int = 10 << 20
    level_factor: int = 10
    levels: int = 4
    codec: str = "zstd"
    segment_bytes: int = 64 << 20
    file_rows: int = 4_000_000
    compact_ms: int = 6 * 3600 * 1000

    def __post_init__(self):
        if self.mode not in ("sorted", "hash") or self.strategy not in ("size_tiered", "leveled"):
            raise ValueError(f"unknown mode or strategy: {self.mode}, {self.strategy}")
        if self.codec not in ("none", "uncompressed", "snappy", "gzip", "lz4", "lz4_raw", "zstd"):
            raise ValueError(f"unknown codec: {self.codec}")
        least = {"max_segments": 1, "tier_files": 2, "level0_files": 1, "level1_bytes": 1, "level_factor": 2, "levels": 1, "segment_bytes": 1, "file_rows": 1, "compact_ms": 0}
        if not 0 <= self.dead_ratio <= 1 or not 0 < self.tier_low <= self.tier_high or any(getattr(self, n) < x for n, x in least.items()):
            raise ValueError("settings out of range")
