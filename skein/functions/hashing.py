"""Hashes: the sampling hash, keyed tokens, and identifiers made of content."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: FNV-1a 64 and the splitmix64 finaliser
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def unit_of(texts: list[str]) -> np.ndarray:
    """Numbers in [0, 1) that depend on the text only; all texts advance a byte a step."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    width = int(size.max(initial=0))
    table = np.zeros((len(raw), width), np.uint8)
    for row, i in enumerate(order):
        table[row, : size[i]] = np.frombuffer(raw[i], np.uint8)
    live = np.searchsorted(-size[order], -np.arange(width), side="left")
    for j in range(width):
        h[: live[j]] = (h[: live[j]] ^ table[: live[j], j]) * np.uint64(FNV_PRIME)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    h ^= h >> np.uint64(31)
    out = np.empty(len(raw))
    out[order] = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return out


@F.pandas_udf(DoubleType())
def hash_unit(key: pd.Series) -> pd.Series:
    """The sampling hash of a string column; null as empty."""
    return pd.Series(unit_of(key.fillna("").tolist()))


def hash_unit_native(key: Column) -> Column:
    """A JVM-side sampling hash: as even, but another sample."""
    return F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 (hex) by built-ins only. The padded key is in the plan: use token_udf where plans are shown."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def token(key: bytes, text: Column) -> Column:
    """tok_ and 24 hexadecimal digits."""
    return F.concat(F.lit("tok_"), F.substring(hmac_sha256(key, text), 1, 24))


def token_of(key: bytes, text: str) -> str:
    import hmac

    return "tok_" + hmac.new(key, text.encode(), hashlib.sha256).hexdigest()[:24]


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:8]


def synthetic_span_id(started_us: Column, kind: Column, content: Column, tool: Column) -> Column:
    """An id of a span without one, from its facts."""
    parts = F.concat_ws("\u0000", started_us.cast("string"), F.coalesce(kind, F.lit("")), F.coalesce(content, F.lit("")), F.coalesce(tool, F.lit("")))
    return F.concat(F.lit("syn-"), F.substring(F.sha2(parts.cast("binary"), 256), 1, 24))
