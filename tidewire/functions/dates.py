"""Dates: freshness natively, lenient parsing of printed dates as an Arrow function."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Russian month stems, genitive month names, Moscow's abbreviations, and tolerances.
RU_MONTHS = {
    "январ": "January", "феврал": "February", "март": "March", "апрел": "April", "ма[йя]": "May", "июн": "June",
    "июл": "July", "август": "August", "сентябр": "September", "октябр": "October", "ноябр": "November", "декабр": "December",
}
RU_MONTH_NAMES = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
MOSCOW_ABBREVIATIONS = ["MSK", "МСК"]
FRESH_DAYS, FUTURE_HOURS, MOSCOW = 3, 12, "Europe/Moscow"
ENGLISH_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

#: A month's name in either language; its number is the place of the group's first letters in the lists.
_NAME = "(?:" + "|".join([*RU_MONTHS, *(m[:3] for m in ENGLISH_MONTHS)]) + r")[a-zа-я]*\.?"
#: How dates are printed, most telling first: what the groups mean, and the pattern.
_PRINTED = [
    ("ymd", re.compile(r"(?<!\d)(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?!\d)")),
    ("dmy", re.compile(r"(?<!\d)(\d{1,2})[./](\d{1,2})[./](\d{4})(?!\d)")),
    ("dny", re.compile(rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+({_NAME})(?:,?[\s-]+(\d{{4}}))?(?!\d)", re.I)),
    ("ndy", re.compile(rf"\b({_NAME})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?(?!\d)", re.I)),
    ("mdy", re.compile(r"(?<!\d)(\d{1,2})[-./](\d{1,2})[-./](\d{2,4})(?!\d)")),
    ("dm", re.compile(r"(?<![\d:.])(\d{1,2})\.(\d{1,2})(?![\d:.])")),
    ("md", re.compile(r"(?<![\d:/])(\d{1,2})/(\d{1,2})(?![\d:/])")),
]
_CLOCK = re.compile(r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*(am|pm)?", re.I)
_OFFSET = re.compile(r"(?:\d|\s)(Z|UTC|GMT)?\s*([+-]\d{2}):?(\d{2})\s*$|\d\s*(Z|UTC|GMT)\b", re.I)


def is_fresh(value: Column, now: Column, days: int = FRESH_DAYS) -> Column:
    """Not older than ``days``, not more than half a day ahead (both ends included)."""
    return value.between(now - F.expr(f"INTERVAL '{days}' DAY"), now + F.expr(f"INTERVAL '{FUTURE_HOURS}' HOUR"))


def is_old(value: Column, now: Column, days: int = FRESH_DAYS) -> Column:
    return value < now - F.expr(f"INTERVAL '{days}' DAY")


def _month(name: str) -> int:
    low = name.lower()
    for names in (list(RU_MONTHS), [m[:3] for m in ENGLISH_MONTHS]):
        for k, stem in enumerate(names, 1):
            if re.match(stem, low):
                return k
    return 0


def _day(text: str) -> tuple[dict[str, int], str] | None:
    """The printed parts of a day by letter, and the text around it; None where no day is printed."""
    for kinds, pattern in _PRINTED:
        for found in pattern.finditer(text):
            parts = {("m" if k == "n" else k): _month(v) if k == "n" else int(v) for k, v in zip(kinds, found.groups(), strict=True) if v is not None}
            if parts.get("y", 100) < 100:
                parts["y"] += 2000 if parts["y"] < 69 else 1900
            if parts["m"] > 12 >= parts["d"]:  # the larger number can only be the day
                parts["m"], parts["d"] = parts["d"], parts["m"]
            if 1 <= parts["m"] <= 12 and 1 <= parts["d"] <= 31:
                return parts, text[: found.start()] + " " + text[found.end() :].lstrip("Tt")
    return None


def parse_printed(value: str | None, timezone: str = MOSCOW, today: datetime | None = None) -> datetime | None:
    """A date printed in Russian or English; None when there is none.

    A day and a clock time are looked for wherever they stand. Numbers that may be
    either are month, then day, but for ``d.m.yyyy``, ``d/m/yyyy`` and ``d.m``. Zone-less dates
    are the site's. A year, or with a mere clock time the day, that is not printed
    comes from ``today`` (default: the current day).
    """
    text = (value or "").strip()
    zone = ZoneInfo(timezone)
    printed = _day(text)
    parts, rest = printed or ({}, text)
    clock = _CLOCK.search(rest)
    if printed is None and clock is None:
        return None
    now = today or datetime.now(zone)
    hour, minute, second = (int(x or 0) for x in clock.groups()[:3]) if clock else (0, 0, 0)
    if clock and clock[4]:
        hour = hour % 12 + 12 * (clock[4].lower() == "pm")
    after = rest[clock.start() :] if clock else ""
    offset = _OFFSET.search(after)
    try:
        read = datetime(parts.get("y", now.year), parts.get("m", now.month), parts.get("d", now.day), hour, minute, second)
        if any(mark in after for mark in MOSCOW_ABBREVIATIONS):
            return read.replace(tzinfo=ZoneInfo(MOSCOW)).astimezone(zone)
        if offset:
            shift = timedelta(hours=int(offset[2]), minutes=int(offset[2][0] + offset[3])) if offset[2] else timedelta()
            return read.replace(tzinfo=UTC).astimezone(zone) - shift
    except (ValueError, OverflowError):
        return None
    return read.replace(tzinfo=zone)


def parse_date(value: Column, timezone: str = MOSCOW, today: str | None = None) -> Column:
    """:func:`parse_printed` of a column. Give ``today`` (ISO) where reruns on another day must agree."""
    day = datetime.fromisoformat(today) if today else None

    @F.pandas_udf("timestamp")
    def run(values: pd.Series) -> pd.Series:
        return pd.to_datetime(values.map(lambda v: parse_printed(v, timezone, day)), utc=True)

    return run(value.cast("string"))


def iso_date(value: Column, timezone: str = MOSCOW) -> Column:
    """ISO dates natively; those without a zone are Moscow's. Null on failure."""
    text = F.trim(value)
    zoned = F.rlike(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$")) & F.contains(text, F.lit(":"))
    moment = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    return F.when(zoned, F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(F.concat(moment, F.lit(f" {timezone}"))))
