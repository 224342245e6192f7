"""Dates as written in feeds and pages, spans of time as typed, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekdays, zone names of mail dates with their offsets, date forms beside ISO, units of a span in seconds.
WEEKDAY = r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
FORMS = ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def written_date(text: Column) -> Column:
    """The time in UTC that a text states: ISO, mail or plain dates; none if it states none; without a zone it is UTC's (the session's)."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    iso = F.regexp_replace(F.regexp_replace(bare, ",", "."), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    iso = F.regexp_replace(iso, r"^([0-9-]{10}[T ][0-9]{2})($|Z|[+-])", "$1:00$2")
    mail = F.regexp_replace(bare, WEEKDAY, "")
    for name, offset in ZONES.items():
        mail = F.regexp_replace(mail, rf" {name}$", f" {offset}")
    return F.coalesce(F.when(bare.rlike(ISO), iso.try_cast("timestamp")), *(F.try_to_timestamp(mail, F.lit(form)) for form in FORMS))


def span_seconds(text: Column) -> Column:
    """Seconds of `1.5h` or `7d`; none for anything else."""
    number = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)[smhdw]$", 1)
    unit = F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.right(F.trim(text), F.lit(1)))
    return F.when(number != "", number.cast("double") * unit)


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """[start, end) in UTC of a local day."""
    return F.to_utc_timestamp(day.cast("date").cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day.cast("date"), 1).cast("timestamp"), zone)


def shortened(text: Column, width: int) -> Column:
    """At most `width` characters, cut between words and marked where cut."""
    cut = F.rtrim(F.regexp_replace(F.left(text, F.lit(width)), r"\s+\S*$", ""))
    return F.when(F.length(text) <= width, text).otherwise(F.concat(cut, F.lit("…")))
