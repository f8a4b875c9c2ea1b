"""Event-time parsing and formatting, UTC throughout, as SQL text."""

from __future__ import annotations

from lurelog.functions.json_values import strip
from lurelog.functions.local import let, quoted

# Layouts accepted besides ISO-8601, once `_TIDY` has run.
EXTRA_LAYOUTS = [
    "MMM d[,] yyyy[ HH:mm[:ss[.SSSSSS]]][[ ]XX]",
    "MMM d[,] yyyy hh:mm[:ss] a",
    "MMM d HH:mm[:ss[.SSSSSS]] yyyy[XX]",
    "d MMM yyyy[ HH:mm[:ss[.SSSSSS]]][[ ]XX]",
    "d MMM yyyy hh:mm[:ss] a",
    "M/d/yyyy[ HH:mm[:ss[.SSSSSS]]]",
    "M/d/yyyy hh:mm[:ss] a",
    "yyyyMMdd['T'HHmm[ss]][XX]",
]
# What is made alike before parsing, in this order.
_TIDY = [
    (r"\s+", " "),  # runs of blanks
    (r"(:[0-9]{2}),([0-9])", "$1.$2"),  # comma before a fraction
    (r"^([0-9]{4})[./]([0-9]{1,2})[./]([0-9]{1,2})", "$1-$2-$3"),  # year first
    (r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", ""),  # day of the week
    (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.]?", "$1"),  # long month names
    (r"(?i) ?(GMT|UTC)( [0-9]{4})?$", "$2Z"),  # zone, before the year too
]

# Years 1 to 9999, the range an event time may lie in.
MIN_EPOCH = -62135596800
MAX_EPOCH = 253402300799


def from_epoch(seconds: str) -> str:
    """Epoch seconds (fractions to the microsecond) to a timestamp."""
    micros = f"try_cast(round({seconds} * 1e6) AS BIGINT)"
    return f"""CASE WHEN {seconds} BETWEEN {MIN_EPOCH} AND {MAX_EPOCH}
                    THEN timestamp_micros({micros}) END"""


def from_text(text: str) -> str:
    """ISO-8601 and the listed layouts; no zone means UTC; a bare time is refused."""
    tidy = strip(text)
    for pattern, replacement in _TIDY:
        tidy = f"regexp_replace({tidy}, r'{pattern}', '{replacement}')"
    others = ", ".join(f"try_to_timestamp(p, {quoted(layout)})" for layout in EXTRA_LAYOUTS)
    # Most times are ISO-8601 as they stand; only others are made alike.
    odd = f"""CASE WHEN p RLIKE r'^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}' THEN try_cast(p AS TIMESTAMP)
                   ELSE coalesce({others}) END"""
    return f"""CASE WHEN {strip(text)} RLIKE r'^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[^,]*$' THEN try_cast({strip(text)} AS TIMESTAMP)
                    ELSE {let("p", tidy, odd)} END"""


def parse_event_time(text: str, string: str) -> str:
    """Timestamp of a value read as text; one that is not a JSON string is epoch seconds."""
    seconds = f"CASE {text} WHEN 'True' THEN 1D WHEN 'False' THEN 0D ELSE try_cast({text} AS DOUBLE) END"
    return f"""CASE WHEN {string} THEN {from_text(text)}
                    ELSE {let("s", seconds, from_epoch("s"))} END"""


def iso_utc(ts: str) -> str:
    """``2025-01-02T03:04:05.678901+00:00``; the fraction is left out when zero."""
    micros = f"lpad(cast(pmod(unix_micros({ts}), 1000000) AS STRING), 6, '0')"
    return f"""concat(date_format({ts}, "yyyy-MM-dd'T'HH:mm:ss"),
                      CASE WHEN pmod(unix_micros({ts}), 1000000) = 0 THEN ''
                           ELSE concat('.', {micros}) END, '+00:00')"""


def window_start(ts: str, minutes: int) -> str:
    """Start of the epoch-aligned tumbling window that holds ``ts``."""
    length = minutes * 60
    return f"timestamp_seconds(floor(unix_seconds({ts}) / {length}) * {length})"
