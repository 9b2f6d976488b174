"""Two days and a flag in one long, ordered like the triple.

A maximum over a struct of dates cannot be kept in a hash aggregate's fixed-width
buffer, so Spark would sort every input row by the group key first. The packed
long keeps "latest row per user" a hash aggregate with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout: first day, then 23 bits for the second day (shifted so that days
# before 1970 stay positive), then one bit for the flag.
_SHIFT = 2_000_000
_SECOND = 1 << 23


def pack_day_pair(first: Column, second: Column, flag: Column | None = None) -> Column:
    bit = F.lit(0) if flag is None else flag.cast("int")
    day = F.unix_date(second) + F.lit(_SHIFT)
    return (F.unix_date(first).cast("long") * _SECOND + day) * 2 + bit


def unpack_second_day(packed: Column) -> Column:
    day = F.pmod(F.shiftright(packed, 1), F.lit(_SECOND)) - F.lit(_SHIFT)
    return F.date_from_unix_date(day.cast("int"))


def unpack_flag(packed: Column) -> Column:
    return F.pmod(packed, F.lit(2)) == 1
