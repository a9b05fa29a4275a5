"""Identifiers by content and by path, and hashes of run settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

FAST_BYTES = 1 << 20


def track_uid(content: Column) -> Column:
    """SHA-256 of the whole content."""
    return F.sha2(content, 256)


def fast_track_uid(content: Column, first: int = FAST_BYTES) -> Column:
    """SHA-256 of the first bytes followed by the size as text."""
    return F.sha2(F.concat(F.substring(content, 1, first), F.octet_length(content).cast("string").cast("binary")), 256)


def track_id(relative_path: Column) -> Column:
    return F.sha1(relative_path)


def clustering_hash(settings: dict) -> str:
    """Eight digits that name a clustering run; every setting counts, its tag as well."""
    return hashlib.md5(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:8]


def manifest_hash(settings: dict) -> str:
    """Eight digits that name a run manifest."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, ensure_ascii=True).encode()).hexdigest()[:8]
