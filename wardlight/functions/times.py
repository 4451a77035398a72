"""Zone-less time arithmetic on a fixed grid of seconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_SHORT = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds_of(span: str | int) -> int:
    """``'5 minutes'``, ``'10s'`` or a number of seconds as whole seconds."""
    if isinstance(span, int):
        return span
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", span.lower())
    if match:
        amount, unit = int(match.group(1)), match.group(2)
        scale = _SHORT.get(unit) or _UNITS.get(unit.rstrip("s"))
        if scale:
            return amount * scale
    raise ValueError(f"not a span of time: {span!r}")


def local(c: Column) -> Column:
    """Any timestamp, date or ISO text as a zone-less timestamp."""
    return c.cast("timestamp_ntz")


def moment(value) -> Column:
    """A Column from a column, ISO text, datetime or None (= now)."""
    if value is None:
        return F.localtimestamp()
    return local(value if isinstance(value, Column) else F.lit(value))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, in any session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), local(c))


def tick_of(c: Column, step: str | int) -> Column:
    """The grid second at or after a timestamp: tick T covers (T - step, T]."""
    width = seconds_of(step)
    return (F.ceil(micros(c) / F.lit(width * 1_000_000)) * F.lit(width)).cast("long")


def at_second(c: Column) -> Column:
    """The zone-less timestamp of a second count since 1970."""
    zero = F.lit(0)
    return F.expr(EPOCH) + F.make_dt_interval(zero, zero, zero, c.cast("decimal(18,6)"))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def iso(c: Column) -> Column:
    """ISO text; the fraction appears only when it is not zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
