"""Time expressions: milliseconds and the formats that foreign timestamps come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitudes that tell seconds from milliseconds and milliseconds from microseconds.
MS_FROM, US_FROM = 1e11, 1e14
RFC2822 = "d MMM yyyy HH:mm:ss Z"  # after the weekday


def millis(ts: str | Column = "ts") -> Column:
    """Milliseconds since 1970 of a naive UTC time, rounded to the nearest."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000).cast("long")


def _epoch(number: Column, per_second: int) -> Column:
    return F.timestamp_micros((number * (1_000_000 / per_second)).cast("long")).cast("timestamp_ntz")


def parse(value: Column, how: str = "auto") -> Column:
    """A naive UTC time from text or a number: ``iso``, ``epoch_s``, ``epoch_ms``, ``epoch_us``, ``rfc2822``,
    a Spark pattern, or ``auto``, which tells epochs apart by size.  Null where nothing fits."""
    text = F.trim(value.cast("string"))
    number = F.expr("null").cast("double") if how in ("iso", "rfc2822") else text.try_cast("double")
    fixed = {"epoch_s": 1, "epoch_ms": 1000, "epoch_us": 1_000_000}
    if how in fixed:
        return _epoch(number, fixed[how])
    iso = text.try_cast("timestamp").cast("timestamp_ntz")
    if how == "iso":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), iso)
    rfc = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3},\s*|\s*\([^)]*\)$", ""), F.lit(RFC2822)).cast("timestamp_ntz")
    if how == "rfc2822":
        return rfc
    if how != "auto":
        return F.try_to_timestamp(text, F.lit(how)).cast("timestamp_ntz")
    size = F.abs(number)
    epoch = F.when(size >= US_FROM, _epoch(number, 1_000_000)).when(size >= MS_FROM, _epoch(number, 1000)).when(size >= 1e8, _epoch(number, 1))
    return F.coalesce(epoch, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), iso), F.when(text.rlike(r"^[A-Z][a-z]{2}, "), rfc))
