"""Dates as feeds write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names and their minutes east of Greenwich. A name that is not listed is UTC, as
# RFC 5322 has it for names without a known offset.
ZONE_MINUTES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "WET": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "ET": -300, "CT": -360, "MT": -420, "PT": -480, "AST": -240, "ADT": -180, "AT": -240,
    "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# Years of two digits from this one on are of the 20th century.
CENTURY_TURN = 90

_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:[.,]\d{1,9})?))?"
_ZONE = r"\s*([+-]\d{2}:?\d{2}|(?:[a-z]+/)?[a-z]+(?:[+-]\d{1,2}(?::?\d{2})?)?)?(?:\s*\([^)]*\))?"
_WEEKDAY = r"(?:[a-z]+\.?,?\s+)?"
_MARK = "\x01"

# The forms in the order they are tried, with the groups of year, month, day, hour, minute, second, zone.
FORMS = (
    # Tue, 30 Jan 2024 10:00:00 GMT; also without weekday, seconds, time or zone, with dashes or a full month
    (rf"(?i)^{_WEEKDAY}(\d{{1,2}})[\s-]+{_MONTH}[\s,-]+(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7)),
    # Tue Jan 30 10:00:00 2024, with a zone before or after the year
    (rf"(?i)^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}}),?\s+{_CLOCK}(?:\s+([a-z]+|[+-]\d{{2}}:?\d{{2}}))?\s+(\d{{4}})$", (7, 1, 2, 3, 4, 5, 6)),
    # Jan 30, 2024 10:00 GMT
    (rf"(?i)^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7)),
    # 2024-01-30T10:00:00+01:00, 20240130, 2024-01, 2024
    (rf"(?i)^(\d{{4}})(?:-?(\d{{2}})(?:-?(\d{{2}}))?)?(?:[t\s]+{_CLOCK}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7)),
)


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _zone_minutes(zone: Column) -> Column:
    """Minutes east of Greenwich of ``+0100``, ``-05:00``, ``EST``, ``GMT+1`` or nothing."""
    offset = F.regexp_extract(zone, r"([+-])(\d{1,2}):?(\d{2})?$", 0)
    digits = F.regexp_replace(offset, "[+:-]", "")
    hours = _number(F.when(F.length(digits) <= 2, digits).otherwise(F.left(digits, F.lit(2))))
    minutes = F.coalesce(_number(F.when(F.length(digits) > 2, F.substring(digits, 3, 2))), F.lit(0))
    named = F.create_map(*(F.lit(x) for pair in ZONE_MINUTES.items() for x in pair))
    name = F.upper(F.regexp_replace(F.regexp_replace(zone, r"[+-].*$", ""), r"^(?i)etc/", ""))
    signed = F.when(F.startswith(offset, F.lit("-")), -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
    return F.when(offset != "", signed).otherwise(F.coalesce(F.try_element_at(named, name), F.lit(0)))


def parse_published(text: Column) -> Column:
    """The moment a feed's date names; NULL where none of the forms fits or the day does not exist.

    Known are RFC 822 and 5322 dates, those of C's ``asctime``, dates with the month in front, and ISO 8601. A
    missing time is midnight, missing months and days are the first, a missing or unknown zone is UTC. A zone
    name stands for its own offset whatever the season. Two-digit years from 90 on are of the 1900s.
    """
    found = F.btrim(text, F.lit(" \t\r\n"))
    for pattern, groups in FORMS:
        found = F.regexp_replace(found, pattern, _MARK + _MARK.join(f"${g}" for g in groups))
    # bound as a lambda's variable, the parts are found once a row and not once a use
    return F.get(F.transform(F.array(F.split(found, _MARK)), _moment), F.lit(0))


def _moment(parts: Column) -> Column:
    """Timestamp of the parts year, month, day, hour, minute, second and zone behind the mark."""
    year, month, day, hour, minute, second, zone = (F.get(parts, F.lit(i)) for i in range(1, 8))
    number = _number(year)
    full_year = F.when(F.length(year) == 4, number).when(number >= CENTURY_TURN, number + 1900).otherwise(number + 2000)
    named_month = ((F.position(F.lower(F.left(month, F.lit(3))), F.lit(MONTHS)) + 2) / 3).cast("int")
    or_zero = lambda c: F.coalesce(_number(c), F.lit(0))
    moment = F.try_make_timestamp(
        full_year,
        F.when(month == "", 1).when(month.rlike(r"^\d"), _number(month)).otherwise(named_month),
        F.when(day == "", 1).otherwise(_number(day)),
        or_zero(hour),
        or_zero(minute),
        F.coalesce(F.translate(second, ",", ".").try_cast("decimal(16,6)"), F.lit(0)),
        F.lit("UTC"),
    )
    return F.when(F.size(parts) == 8, F.timestamp_add("MINUTE", -_zone_minutes(zone), moment))
