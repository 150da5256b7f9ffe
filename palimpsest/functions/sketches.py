"""Signatures of sets: keyed event hashes and salted minima."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the step between salts.
_STEP = 0x9E3779B97F4A7C15


def event_hashes(key: str, owner: Column, events: Column) -> Column:
    """Sorted distinct 16-digit hashes of a set of events under a key, so that sets can be compared without showing their texts."""
    return F.array_sort(F.array_distinct(F.transform(events, lambda e: F.substring(F.sha2(F.concat_ws("|", F.lit(key), owner, e), 256), 1, 16))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def salted_minima(hashes: Column, k: int = 128) -> Column:
    """``k`` minima, as 16 hex digits, of 64-bit hashes (16 hex digits each) under exclusive or with salts i * step + 1; empty for none.

    Longs are signed here: with the top bit turned their order is that of the unsigned numbers."""
    top = F.lit(_signed(1 << 63))
    salts = F.array(*(F.lit(_signed((i * _STEP + 1) & 0xFFFFFFFFFFFFFFFF)) for i in range(k)))
    # conv gives the unsigned number in text; its halves fit a long.
    number = lambda h: F.shiftleft(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(h, 9, 8), 16, 10).cast("long"))
    least = lambda v: F.transform(salts, lambda s: F.array_min(F.transform(v, lambda x: x.bitwiseXOR(s).bitwiseXOR(top))).bitwiseXOR(top))
    signature = F.get(F.transform(F.array(F.transform(hashes, number)), least), F.lit(0))
    return F.when(F.size(hashes) > 0, F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 16, "0")))).otherwise(F.array().cast("array<string>"))


def signature_likeness(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures: an estimate of their sets' Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.greatest(F.lit(1), F.size(a))
