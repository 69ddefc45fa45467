"""Publication labels as times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
UNIT = r"(\d+|un|una)\s*(min(?:ut[oie])?|minute|h|or[ae]|g|giorn[oi])(?:\s|$)"
FORMATS = (("dd/MM/yyyy HH:mm", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$"), ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"))


def label_time_ms(label: Column, seen_ms: Column) -> Column:
    """When something was published: a relative label counts back from when it was seen, a date is absolute; else null."""
    low = F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))
    n = F.regexp_extract(low, UNIT, 1)
    unit = F.regexp_extract(low, UNIT, 2)
    count = F.when(n.isin("un", "una"), 1).otherwise(n.try_cast("long"))
    size = F.when(unit.startswith("min"), 60_000).when((unit == "h") | unit.startswith("or"), 3_600_000).otherwise(DAY)
    plain = F.trim(F.regexp_replace(label, "(?i)^pubblicato il ", ""))
    dates = [F.when(plain.rlike(p), F.unix_millis(F.try_to_timestamp(plain, F.lit(f)))) for f, p in FORMATS]
    return F.when(low.isin("oggi", "pubblicato oggi"), seen_ms).when(low.isin("ieri", "pubblicato ieri"), seen_ms - DAY).when(unit != "", seen_ms - count * size).otherwise(F.coalesce(*dates))


def page_time_ms(html: Column) -> Column:
    """First time in a page: an ISO instant, or epoch seconds or milliseconds under a created or timestamp key."""
    iso = F.regexp_extract(html, r"\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1)
    epoch = F.regexp_extract(html, r'"(?:created_at|timestamp|created)[a-z_]*"\s*:\s*"?(\d{10,13})', 1).try_cast("long")
    return F.coalesce(F.unix_millis(F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss"))), F.when(epoch < 100_000_000_000, epoch * 1000).otherwise(epoch))


def local_day(ms: Column, zone: str) -> tuple[Column, Column, Column]:
    """The day of a moment in a zone, as days since 1970, and the day's first and last millisecond: 23 to 25 hours, as clocks are changed.

    The session's own zone doesn't matter.
    """
    day = F.floor(F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone)) / DAY)
    begin = lambda d: F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(d * DAY), zone))
    return day, begin(day), begin(day + 1) - 1
