"""Byte sizes as text and back."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit labels, smallest first.
METRIC_UNITS = ["B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
BINARY_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"]

# Accepted multiplier letters of a byte count.
BYTE_LETTERS = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4}
BYTES_PATTERN = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([kKmMgGtT]?)[bB]?\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times; keeps generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(value: Column, digits: int) -> Column:
    """``%.<digits>f`` of a non-negative double, rounding the exact binary value half to even.

    Java's formatter rounds the shortest decimal text half up instead, which
    turns 2.25 into 2.3. Whole part and rest are exact in a double; the rest is scaled
    to an integer by a power of two and rounded in integer arithmetic. Values of 2**62
    and more have no rest.
    """

    def scaled(v: Column) -> Column:
        whole = F.floor(F.least(v, F.lit(float(2**62)))).cast("bigint")
        rest = ((v - whole.cast("double")) * F.lit(float(2**62))).cast("bigint").cast("decimal(20,0)")
        wide = rest * F.lit(10**digits).cast("decimal(5,0)")
        return F.struct(wide.cast("decimal(38,0)").alias("wide"), F.lit(2**62).cast("decimal(20,0)").alias("one"), whole.alias("whole"))

    def divided(p: Column) -> Column:
        rest = p["wide"] % p["one"]
        units = ((p["wide"] - rest) / p["one"]).cast("bigint")
        return F.struct((rest * 2).alias("twice"), units.alias("units"), p["one"].alias("one"), p["whole"].alias("whole"))

    def rounded(p: Column) -> Column:
        odd = (p["units"] + p["whole"] * F.lit(10**digits % 2)) % 2 == 1
        up = (p["twice"] > p["one"]) | ((p["twice"] == p["one"]) & odd)
        units = p["units"] + F.when(up, 1).otherwise(0)
        full = units >= 10**digits
        return F.struct((p["whole"] + full.cast("bigint")).alias("whole"), F.when(full, 0).otherwise(units).alias("units"))

    def shown(p: Column) -> Column:
        if digits == 0:
            return p["whole"].cast("string")
        return F.concat(p["whole"].cast("string"), F.lit("."), F.lpad(p["units"].cast("string"), digits, "0"))

    def exact(v: Column) -> Column:
        text = let(let(let(scaled(v), divided), rounded), shown)
        return F.when(v < float(2**62), text).otherwise(F.format_string(f"%.{digits}f", v))

    return let(value.cast("double"), exact)


def size_desc(number: Column, metric: bool = False, precision: int = 1) -> Column:
    """Human-readable byte size: the first unit whose rounded value stays below the step."""
    if not 0 <= precision <= 3:
        raise ValueError("precision must be 0 to 3")
    units = METRIC_UNITS if metric else BINARY_UNITS
    step = 1000.0 if metric else 1024.0
    limit = step - 0.5 * 10**-precision

    def text(n: Column) -> Column:
        value, choices = F.abs(n), []
        for unit in units:
            choices.append(F.struct(value.alias("value"), F.lit(unit).alias("unit")))
            value = value / step
        fits = F.filter(F.array(*choices), lambda c: c["value"] < limit)
        sign = F.when(n < 0, "-").otherwise("")
        chosen = F.coalesce(F.get(fits, F.lit(0)), choices[-1])
        return let(chosen, lambda c: F.concat(sign, fixed(c["value"], precision), F.lit(" "), c["unit"]))

    return F.when(number.isNotNull(), let(number.cast("double"), text))


def parse_bytes(text: Column) -> Column:
    """``12mB`` to bytes (powers of 1024); null when it is not a byte count."""
    letter = F.lower(F.regexp_extract(text, BYTES_PATTERN, 2))
    factor = F.lit(1)
    for name, power in BYTE_LETTERS.items():
        factor = F.when(letter == name, F.lit(1024**power)).otherwise(factor)
    number = F.regexp_extract(text, BYTES_PATTERN, 1).try_cast("double")
    return F.when(text.rlike(BYTES_PATTERN), (number * factor).cast("bigint"))


def bytes_value(text: str) -> int:
    """The same for a configuration value; bad text is an error."""
    match = re.match(BYTES_PATTERN, text)
    if not match:
        raise ValueError(f"not a byte count: {text!r}")
    return int(float(match.group(1)) * 1024 ** BYTE_LETTERS[match.group(2).lower()])
