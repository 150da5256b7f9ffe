"""Dates, ids, numbers, hashes and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def slug_date(meeting_id: Column) -> Column:
    """'YYYY-MM-DD 00:00:00' of a slug such as aug14_2025, oct30_2_2025 or apr28_2025_2; null where it is none."""
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.regexp_extract(F.lower(meeting_id), r"^([a-z]{3})[0-9]{1,2}_", 1))
    day = F.regexp_extract(meeting_id, r"^[A-Za-z]{3}([0-9]{1,2})_", 1)
    year = F.regexp_extract(meeting_id, r"_([0-9]{4})(?:_|$)", 1)
    good = (month > 0) & day.try_cast("int").between(1, 31) & (year != "")
    return F.when(good, F.concat(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), F.lit(" 00:00:00")))


def meeting_month(meeting_id: Column) -> Column:
    """'YYYY-MM' of a slug."""
    return F.left(slug_date(meeting_id), F.lit(7))


def without_session(meeting_id: Column) -> Column:
    """A slug without its session counter: oct30_2_2025 is oct30_2025."""
    return F.regexp_replace(F.regexp_replace(meeting_id, r"^([A-Za-z]{3}[0-9]{1,2})_[0-9]{1,2}_(?=[0-9]{4}$)", "$1_"), r"(_[0-9]{4})_[0-9]{1,2}$", "$1")


def iso_to_seconds_text(iso: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS' cut out of ISO text, as text: that is what dates are compared as."""
    return F.concat_ws(" ", F.substring(iso, 1, 10), F.substring(iso, 12, 8))


def span_key(url: Column, start: Column, end: Column) -> Column:
    """A span's identity: its recording and its ends in whole hundredths of a second."""
    return F.concat_ws("|", url, F.round(start * 100).cast("long").cast("string"), F.round(end * 100).cast("long").cast("string"))


def row_signature(*parts: Column) -> Column:
    """16 hex digits over the parts; changes with any of them, so stored results of other inputs are seen to be stale."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def valid_confidence(c: Column) -> Column:
    return F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False))


def phase(t: Column, origin: float, period: float) -> Column:
    """Place of a time within its period."""
    return F.pmod(t - F.lit(origin), F.lit(period))


def floor_grid(x: Column, step: float = 0.02) -> Column:
    return F.round(F.floor(x / step + 1e-9) * step, 2)


def ceil_grid(x: Column, step: float = 0.02) -> Column:
    return F.round(F.ceil(x / step - 1e-9) * step, 2)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the trimmed lower-case text's UTF-16 units, as a long."""
    t = F.lower(F.trim(text))
    step = lambda h, i: F.pmod((h.bitwiseXOR(F.ascii(F.substring(t, i, F.lit(1))).cast("long"))) * 16777619, F.lit(1 << 32))
    return F.when(F.length(t) > 0, F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(2166136261).cast("long"), step)).otherwise(F.lit(2166136261).cast("long"))


def hash_order(seed: str, *keys: Column) -> Column:
    """A seeded order that every engine with MD5 reproduces."""
    return F.md5(F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(seed)))


def md5_bucket(key: Column, buckets: int) -> Column:
    """MD5 as a 128-bit number modulo ``buckets``, without 128-bit arithmetic: digit by digit."""
    digits = F.md5(key.cast("string"))
    value = lambda i: F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0).cast("long"), lambda acc, i: (acc * 16 + value(i)) % buckets)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of a proportion; null where k of n is none."""
    p, n = k / n, n.cast("double")
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when((n > 0) & (k >= 0) & (k <= n), F.struct((mid - half).alias("low"), (mid + half).alias("high")))


def json_array(text: Column, schema: str) -> Column:
    """The JSON array in a free text: a fenced block's, else what stands between the outermost brackets; null if neither parses."""
    fenced = F.from_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1), schema)
    return F.coalesce(fenced, F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), schema))


def padded(array: Column, n: int) -> Column:
    """The first ``n`` elements, with nulls where there are fewer."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(array, i))


def as_list(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def duration_bucket(seconds: Column) -> Column:
    edges = ((1, "<1s"), (3, "1-3s"), (5, "3-5s"), (10, "5-10s"), (20, "10-20s"), (30, "20-30s"))
    out = F.lit(">=30s")
    for edge, name in reversed(edges):
        out = F.when(seconds < edge, name).otherwise(out)
    return F.when(seconds.isNotNull(), out)


def coalesce_span(start: Column, end: Column, start_adj: Column, end_adj: Column) -> Column:
    """The adjusted span where both its ends are numbers, else the raw one."""
    good = start_adj.isNotNull() & end_adj.isNotNull() & ~F.isnan(start_adj) & ~F.isnan(end_adj)
    return F.struct(F.when(good, start_adj).otherwise(start).alias("start"), F.when(good, end_adj).otherwise(end).alias("end"))
