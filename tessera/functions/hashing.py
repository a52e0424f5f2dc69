"""Subject hashing and canonical digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 1 << 256


def boundary(ratio: float) -> str | None:
    """The least 256-bit number, in 64 hex digits, whose double over 2**256 is at least ratio;
    None if there is none. A hash scores under ratio just where its hex digits sort before."""
    edge, low, high = ratio * float(SPACE), 0, SPACE
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if float(mid) >= edge else (mid + 1, high)
    return None if low >= SPACE else f"{low:064x}"


def subject_hash(subject: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), subject.cast("string")), 256)


def below(hex_digits: Column, ratio: float) -> Column:
    edge = boundary(ratio)
    return F.lit(True) if edge is None else hex_digits < edge


def canonical_json(value: object, ascii_only: bool = True) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def vocabulary_digest(labels) -> str:
    """Of the compact JSON list of the sorted labels."""
    return sha256_hex(canonical_json(sorted(labels)))
