"""Written times: layouts, offsets and zones."""

from __future__ import annotations

import re
from calendar import timegm
from datetime import datetime
from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of the languages in the feeds, lower case.
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene janeiro января",
    2: "feb february februar février févr fevrier febrero fevereiro fev февраля",
    3: "mar march märz maerz mrz mars marzo março марта",
    4: "apr april avril avr abril abr апреля",
    5: "may mai mayo maio мая",
    6: "jun june juni juin junio junho июня",
    7: "jul july juli juillet juil julio julho июля",
    8: "aug august août aout agosto ago августа",
    9: "sep sept september septembre septiembre setembro set сентября",
    10: "oct october oktober okt octobre octubre outubro out октября",
    11: "nov november novembre noviembre novembro ноября",
    12: "dec december dezember dez décembre déc decembre diciembre dic dezembro декабря",
}
MONTH_OF = {word: n for n, words in MONTHS.items() for word in words.split()}

# Zone abbreviations in their usual news meaning, minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60,
    "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120,
    "IST": 330, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150, "BRT": -180, "ART": -180,
}

TIME = r"(?P<h>\d{1,2})[:h](?P<n>\d\d)(?::(?P<s>\d\d)(?:[.,]\d+)?)?"
HALF = r"(?: ?(?P<half>[ap])\.?m\.?)?(?: ?(?:uhr|hrs))?"
ZONE = r"(?: ?(?P<zone>z|[a-z]{2,5}|[+-]\d\d(?::?\d\d)?|(?:utc|gmt)[+-]\d\d?(?::?\d\d)?))?(?: ?\[?(?P<name>[a-z]+(?:/[a-z0-9_+-]+)+|utc|gmt)\]?)?"
DOW = r"(?:[^\W\d_]{2,10}\.?,? )?"

#: layout -> pattern; the layouts of one value are all that match and name an existing date.
LAYOUTS = {
    name: re.compile(rf"{pattern}\Z", re.I)
    for name, pattern in {
        "iso": rf"(?P<y>\d{{4}})[-/](?P<m>\d\d?)[-/](?P<d>\d\d?)[t ]{TIME}{HALF}{ZONE}",
        "compact": rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)[t ](?P<h>\d\d)(?P<n>\d\d)(?P<s>\d\d)?(?:\.\d+)?{ZONE}",
        "day_month_name": rf"{DOW}(?P<d>\d\d?)(?:\.|st|nd|rd|th|º|er)? ?(?:de )?(?P<m>[^\W\d_]{{3,10}})\.?,? (?:de )?(?P<y>\d{{4}}|\d\d),?(?: (?:à|at|um|às|a las))? {TIME}{HALF}{ZONE}",
        "month_name_day": rf"{DOW}(?P<m>[^\W\d_]{{3,10}})\.? (?P<d>\d\d?)(?:st|nd|rd|th)?,? (?P<y>\d{{4}}),?(?: at)? {TIME}{HALF}{ZONE}",
        "dotted": rf"{DOW}(?P<d>\d\d?)\.(?P<m>\d\d?)\.(?P<y>\d{{4}}),?(?: um)? {TIME}{HALF}{ZONE}",
        "slash_day_first": rf"{DOW}(?P<d>\d\d?)/(?P<m>\d\d?)/(?P<y>\d{{4}}),?(?: at)? {TIME}{HALF}{ZONE}",
        "slash_month_first": rf"{DOW}(?P<m>\d\d?)/(?P<d>\d\d?)/(?P<y>\d{{4}}),?(?: at)? {TIME}{HALF}{ZONE}",
    }.items()
}
#: layout -> (pattern, seconds a unit)
EPOCHS = {"epoch_s": (re.compile(r"\d{9,10}(?:\.\d+)?\Z"), 1), "epoch_ms": (re.compile(r"\d{12,13}\Z"), 1000), "epoch_us": (re.compile(r"\d{15,16}\Z"), 1_000_000)}


@lru_cache(maxsize=1)
def _zones() -> dict[str, str]:
    return {x.lower(): x for x in available_timezones()}


def offset_of(text: str) -> int | None:
    """Seconds east of UTC of an offset or abbreviation; None for neither."""
    if (minutes := ABBREVIATIONS.get(text.upper())) is not None:
        return minutes * 60
    if not (m := re.fullmatch(r"(?:utc|gmt)?([+-])(\d\d?):?(\d\d)?", text, re.I)):
        return None
    hours, minutes = int(m[2]), int(m[3] or 0)
    return (1 if m[1] == "+" else -1) * (hours * 3600 + minutes * 60) if hours <= 14 and minutes < 60 else None


def _reading(layout: str, m: re.Match) -> tuple | None:
    part = m.groupdict()
    year = int(part["y"])
    if len(part["y"]) == 2:
        year += 2000 if year < 50 else 1900
    month = MONTH_OF.get(part["m"].lower()) if not part["m"].isdigit() else int(part["m"])
    hour = int(part["h"])
    if half := part.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half.lower() == "p")
    try:
        wall = timegm(datetime(year, month or 0, int(part["d"]), hour, int(part["n"]), int(part["s"] or 0)).timetuple())
    except ValueError:
        return None
    zone, name = part["zone"], part["name"]
    if zone and zone.lower() == "uhr":
        zone = None
    utc = None
    if zone:
        if (off := offset_of(zone)) is None:
            return None
        utc = wall - off
    if name and (name := _zones().get(name.lower())) is None:
        return None
    return layout, wall, utc, name


def readings(value: str | None) -> tuple[tuple[str, int, int | None, str | None], ...]:
    """All readings (layout, wall second, utc second, zone name) of a written time.

    Null, empty, relative and dateless values have none.
    """
    text = " ".join((value or "").split())
    return (_readings if len(text) < 100 else _readings.__wrapped__)(text) if text else ()


@lru_cache(maxsize=65536)
def _readings(text: str) -> tuple[tuple[str, int, int | None, str | None], ...]:
    for layout, (pattern, unit) in EPOCHS.items():
        if pattern.match(text):
            second = int(text.split(".")[0]) // unit
            return ((layout, second, second, None),)
    found = ((layout, pattern.match(text)) for layout, pattern in LAYOUTS.items())
    return tuple(r for layout, m in found if m and (r := _reading(layout, m)))


def zoned_instant(wall: Column, zone: Column) -> Column:
    """The UTC second of wall second ``wall`` in ``zone``; null when that clock showed it twice or never.

    ``zone`` must be a name of the zone database or null. Doesn't depend on the session's zone.
    """
    back = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), zone))
    utc = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), zone))
    shifts = F.array(*[F.lit(d) for shift in (1200, 1800, 3600, 7200, 10800) for d in (shift, -shift)])
    twice = F.exists(shifts, lambda d: back(utc + d) == wall)
    return F.when((back(utc) == wall) & ~twice, utc)
