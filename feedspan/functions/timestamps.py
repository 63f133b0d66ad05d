"""Date parsing, formatting and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts by the shape of the text, tried in this order. Zones are numeric here:
# `_with_offset` has turned zone names into offsets, and AM and PM stand after one space.
CLOCK = "[ H:mm:ss][ H:mm][.SSSSSSSSS][.SSSSSS][.SSS][ XXX][ XX][ X]"
CLOCK_12 = " h:mm[:ss] a[ XXX][ XX][ X]"
LAYOUTS = {
    r"^\d{4}-\d{1,2}-\d{1,2}T": ["yyyy-M-d'T'H:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][XXX][XX][X][ XXX][ XX]"],
    r"^\d{4}-\d{1,2}-\d{1,2}": ["yyyy-M-d" + CLOCK, "yyyy-M-d[ H:mm:ss][ H:mm][XXX][XX]", "yyyy-M-d" + CLOCK_12],
    r"^\d{4}-\d{1,2}$": ["yyyy-M"],
    r"^\d{4}-[A-Z]": ["yyyy-MMM-d"],
    r"^\d{4}/": ["yyyy/M/d" + CLOCK, "yyyy/M/d" + CLOCK_12],
    r"^\d{4}\.\d": ["yyyy.M.d" + CLOCK, "yyyy.M"],
    r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}": ["M/d/yyyy" + CLOCK, "M/d/yyyy" + CLOCK_12, "M.d.yyyy" + CLOCK],
    r"^\d{1,2}[/.]\d{1,2}[/.]\d{2}\b": ["M/d/yy" + CLOCK, "M/d/yy" + CLOCK_12, "M.d.yy" + CLOCK],
    r"^\d{1,2}[- ][A-Z][a-z]{2}[- ]\d{4}": ["d MMM yyyy" + CLOCK, "d MMM yyyy" + CLOCK_12, "d-MMM-yyyy" + CLOCK],
    r"^\d{1,2}[- ][A-Z][a-z]{2}[- ]\d{2}\b": ["d MMM yy" + CLOCK, "d MMM yy" + CLOCK_12, "d-MMM-yy" + CLOCK],
    r"^[A-Z][a-z]{2} \d{1,2} \d{1,2}:": ["MMM d H:mm:ss[ XXX][ XX] yyyy"],
    r"^[A-Z][a-z]{2} \d": ["MMM d yyyy" + CLOCK, "MMM d yyyy" + CLOCK_12],
    r"^[A-Z][a-z]{2} \d{4}$": ["MMM yyyy"],
    r"^\d{4}[A-Z]": ["yyyyMMMd", "yyyy MMM d"],
    r"^\d{14}$": ["yyyyMMddHHmmss"],
    r"^\d{8}$": ["yyyyMMdd"],
    r"^\d{6}$": ["yyyyMM"],
    r"^\d{4}$": ["yyyy"],
}
# Zone names of mail dates, in hours from UTC. Other names are read as UTC.
ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "BST": 1}

WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+"


def as_ntz(moment: str | Column) -> Column:
    """A zone-less timestamp column from a literal or a column."""
    return F.to_timestamp_ntz(F.lit(moment)) if isinstance(moment, str) else moment


def minutes(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return n.cast("bigint") * F.expr("INTERVAL '1' MINUTE")


MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"


def _by_shape(clean: Column) -> Column:
    """Try the layouts of the first shape that fits; then epoch digits."""
    parsed = None
    for shape, layouts in LAYOUTS.items():
        fit = F.coalesce(*[F.try_to_timestamp(clean, F.lit(p)) for p in layouts])
        hit = clean.rlike(shape)
        parsed = F.when(hit, fit) if parsed is None else parsed.when(hit, fit)
    digits = clean.try_cast("bigint")
    return (
        parsed.when(clean.rlike(r"^\d{10}$"), F.timestamp_micros(digits * 1_000_000))
        .when(clean.rlike(r"^\d{13}$"), F.timestamp_micros(digits * 1_000))
        .when(clean.rlike(r"^\d{16}$"), F.timestamp_micros(digits))
    )


def _with_offset(clean: Column) -> Column:
    """A zone name at the end, or before a closing year, as a numeric offset."""
    named = F.regexp_extract(clean, r"(?<=\d|\s[AP]M|[+-]\d{4}) ([A-Z]{3,4})(?= \d{4}$|$)", 1)
    hours = F.lit("+00:00")
    for name, h in ZONES.items():
        hours = F.when(named == name, F.lit(f"{h:+03d}:00")).otherwise(hours)
    # Where a numeric offset stands already, the name after it only repeats it.
    told = clean.rlike(r"[+-]\d{2}:?\d{2} [A-Z]{3,4}$")
    bare = F.regexp_replace(clean, r"(?<=\d|\s[AP]M) [A-Z]{3,4}$", "")
    whole = F.when(told, bare).otherwise(
        F.regexp_replace(clean, F.lit(r"(?<=\d|\s[AP]M) ([A-Z]{3,4})(?= \d{4}$|$)"), F.concat(F.lit(" "), hours)))
    is_zone = (named != "") & ~named.isin("AM", "PM") & ~F.initcap(named).isin(
        *"Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())
    return F.when(is_zone | told, whole).otherwise(clean)


def parse_any_timestamp(text: Column) -> Column:
    """A timestamp from any known layout, else NULL; texts without a zone are UTC.

    Weekday names, ordinal endings and commas are dropped, month names shortened, zone names turned
    into offsets. Two-digit years are those of this century. Each cleaned text is bound to a lambda,
    so it is computed once per row and not once per layout.
    """
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), WEEKDAY, "")
    clean = F.regexp_replace(clean, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    # A year, month and day by their characters, a comma before a fraction, "at" before the time.
    clean = F.regexp_replace(clean, r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*", "$1-$2-$3 ")
    clean = F.regexp_replace(F.rtrim(clean), r"(:\d{2}),(\d{1,9})\b", "$1.$2")
    clean = F.regexp_replace(clean, r"(?i)\s+at\s+(?=\d)", " ")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\s*\([A-Za-z ]+\)$", ""), r",\s*", " ")
    clean = F.regexp_replace(clean, r"(?i)(\d)\s?(am|pm)\b", "$1 $2")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    # GMT+0100, PST-08: the name only introduces the offset.
    clean = F.regexp_replace(clean, r"\s?\b[A-Z]{3,4}([+-]\d{2}(?::?\d{2})?)$", " $1")
    month = F.initcap(F.substring(F.regexp_extract(clean, MONTH, 0), 1, 3))
    clean = F.when(clean.rlike(MONTH), F.regexp_replace(clean, F.lit(MONTH), month)).otherwise(clean)
    whole = F.transform(F.array(clean), _with_offset)
    return F.transform(whole, _by_shape)[0]


def format_timestamp(text: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` from an ISO date or timestamp, in its own zone; blank if invalid."""
    iso = r"^(\d{4}-\d{2}-\d{2})(?:T(\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))?$"
    day, clock = F.regexp_extract(text, iso, 1), F.regexp_extract(text, iso, 2)
    wall = F.concat_ws(" ", day, F.when(clock == "", F.lit("00:00:00")).otherwise(clock))
    parsed = F.try_to_timestamp(wall, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(parsed.isNotNull(), wall).otherwise(F.lit(""))


def plan_end_date(duration: Column, start: Column) -> Column:
    """End of a plan; month and year steps clamp to the month's last day."""
    step = lambda text: start + F.expr(text)
    return (
        F.when(duration == "day", step("INTERVAL '1' DAY"))
        .when(duration == "week", step("INTERVAL '7' DAY"))
        .when(duration == "month", step("INTERVAL '1' MONTH"))
        .when(duration == "year", step("INTERVAL '1' YEAR"))
        .otherwise(start)
    )


def refine_interval(value: Column, default: int, longest: int) -> Column:
    """The requested minutes, or the default when missing, not positive or too long."""
    return F.when((value > 0) & (value <= longest), value).otherwise(F.lit(default))


def interval_seconds(gap: Column) -> Column:
    """A day-time interval as seconds (double)."""
    part = lambda unit: F.extract(F.lit(unit), gap).cast("double")
    return part("DAY") * 86400.0 + part("HOUR") * 3600.0 + part("MINUTE") * 60.0 + part("SECOND")
