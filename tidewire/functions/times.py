"""Times, durations, %-formats and poll rates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The %-codes of the C locale as Spark datetime patterns.
STRFTIME_CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss",
    "j": "DDD", "I": "hh", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "f": "SSSSSS", "Z": "'UTC'", "z": "'+0000'",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "h": "MMM",
}

# Unit spellings of a duration, and seconds per unit.
DURATION_UNITS = [
    ("years", r"y(?:ea)?rs?\.?|ys?|years?", 365 * 86400.0),
    ("months", r"mo(?:nth)?s?\.?|mths?\.?", 30 * 86400.0),
    ("weeks", r"w(?:ee)?ks?|w", 7 * 86400.0),
    ("days", r"days?|dys?|d", 86400.0),
    ("hours", r"hours?|hrs?|h", 3600.0),
    ("minutes", r"minutes?|mins?|m", 60.0),
    ("seconds", r"seconds?|secs?|s", 1.0),
]
_NUMBER = r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
_PLAIN = r"^\s*([+-]?)\s*" + _NUMBER + r"\s*$"
_WORDS = r"(?i)^\s*([+-]?)\s*" + "".join(
    rf"(?:{_NUMBER}\s*(?:{spelling})(?![a-z])\s*[,/]?\s*)?" for _, spelling, _ in DURATION_UNITS
) + r"$"
_CLOCK = r"^\s*([+-]?)\s*([0-9]{1,2}):([0-9]{2}(?:\.[0-9]+)?)\s*$"
_LONG_CLOCK = (
    r"(?i)^\s*([+-]?)\s*"
    + "".join(rf"(?:{_NUMBER}\s*(?:{DURATION_UNITS[i][1]})(?![a-z])\s*[,/]?\s*)?" for i in (2, 3))
    + r"([0-9]+):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)\s*$"
)
_DAY_CLOCK = r"^\s*([+-]?)\s*([0-9]+):([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)\s*$"

# (pattern, seconds per group) in the order they are tried
_DURATION_FORMS = [
    (_PLAIN, [1.0]),
    (_WORDS, [seconds for _, _, seconds in DURATION_UNITS]),
    (_CLOCK, [60.0, 1.0]),
    (_LONG_CLOCK, [7 * 86400.0, 86400.0, 3600.0, 60.0, 1.0]),
    (_DAY_CLOCK, [86400.0, 3600.0, 60.0, 1.0]),
]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("bigint")).cast("timestamp_ntz")


def epoch(ts: Column) -> Column:
    """Seconds since the epoch, microseconds kept."""
    return micros(ts) / F.lit(1e6)


def seconds(interval: Column) -> Column:
    """Seconds of a day-time interval, microseconds kept."""
    minutes = (
        F.extract(F.lit("DAY"), interval) * 1440
        + F.extract(F.lit("HOUR"), interval) * 60
        + F.extract(F.lit("MINUTE"), interval)
    )
    rest = (F.extract(F.lit("SECOND"), interval) * 1000000).cast("bigint")
    return (minutes.cast("bigint") * 60000000 + rest) / F.lit(1e6)


def elapsed(start: Column, stop: Column) -> Column:
    """Seconds from start to stop."""
    return (micros(stop) - micros(start)) / F.lit(1e6)


def parse_timedelta(text: Column) -> Column:
    """Duration text to seconds; null when it is not a duration."""
    result = F.lit(None).cast("double")
    for pattern, weights in reversed(_DURATION_FORMS):
        total = F.lit(0.0)
        for group, weight in enumerate(weights, start=2):
            part = F.regexp_extract(text, pattern, group)
            total = total + F.when(part == "", 0.0).otherwise(part.try_cast("double")) * weight
        sign = F.when(F.regexp_extract(text, pattern, 1) == "-", -1.0).otherwise(1.0)
        result = F.when(text.rlike(pattern) & text.rlike("[0-9]"), total * sign).otherwise(result)
    return result


def duration(value: str | int | float) -> float:
    """Configuration form of the same: seconds, or ValueError."""
    if isinstance(value, (int, float)):
        return float(value)
    for pattern, weights in _DURATION_FORMS:
        match = re.match(pattern, value)
        if match and re.search("[0-9]", value):
            total = sum(float(g) * w for g, w in zip(match.groups()[1:], weights) if g)
            return -total if match.group(1) == "-" else total
    raise ValueError(f"not a duration: {value!r}")


def duration_micros(value: str | int | float) -> int:
    return round(duration(value) * 1e6)


def _pieces(fmt: str) -> list[tuple[str, str]]:
    """Split a %-format into ("code", c) and ("text", literal) pieces."""
    fmt = fmt.replace("%c", "%a %b %e %H:%M:%S %Y")
    pieces: list[tuple[str, str]] = []
    text, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            if code == "%":
                text += "%"
            elif code in STRFTIME_CODES or code in "es":
                if text:
                    pieces.append(("text", text))
                    text = ""
                pieces.append(("code", code))
            else:
                text += "%" + code
            i += 2
        else:
            text += fmt[i]
            i += 1
    if text:
        pieces.append(("text", text))
    return pieces


def strftime(ts: Column, fmt: str) -> Column:
    """Format with %-codes (C locale, UTC)."""
    out: list[Column] = []
    pattern = ""

    def flush() -> None:
        nonlocal pattern
        if pattern:
            out.append(F.date_format(ts, pattern))
            pattern = ""

    for kind, piece in _pieces(fmt):
        if kind == "text":
            # Letters must be quoted in a datetime pattern; keep literals outside it.
            flush()
            out.append(F.lit(piece))
        elif piece == "e":
            flush()
            out.append(F.lpad(F.date_format(ts, "d"), 2, " "))
        elif piece == "s":
            flush()
            out.append(F.unix_seconds(ts.cast("timestamp")).cast("string"))
        else:
            flush()
            pattern = STRFTIME_CODES[piece]
    flush()
    if not out:
        return F.when(ts.isNotNull(), F.lit(""))
    return F.when(ts.isNotNull(), F.concat(*out))


def strptime(text: Column, fmt: str) -> Column:
    """Parse with %-codes; zone-less results are UTC. Null when the text does not fit."""
    pattern = ""
    for kind, piece in _pieces(fmt):
        if kind == "code":
            pattern += {"z": "xx", "Z": "VV"}.get(piece, STRFTIME_CODES.get(piece, "d"))
        else:
            pattern += "".join(f"'{c}'" if c.isalpha() else ("''" if c == "'" else c) for c in piece)
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def next_tick(ts: Column, period: str | float, offset: str | float = 0, sync: bool = True) -> Column:
    """When a poll waiting at ``ts`` wakes up: aligned to period + offset, or one period later."""
    step, shift = duration_micros(period), duration_micros(offset)
    us = micros(ts)
    wait = F.lit(step) - F.pmod(us - F.lit(shift), F.lit(step)) if sync else F.lit(step)
    return from_micros(us + wait)
