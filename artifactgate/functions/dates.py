"""Times given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def iso_time(text: Column) -> Column:
    """The moment of an ISO date or time; null for any other text. A time without an offset is one of UTC."""
    part = lambda k: F.regexp_extract(text, _ISO, k)
    or_else = lambda k, other: F.when(part(k) != "", part(k)).otherwise(F.lit(other))
    digits = F.regexp_replace(part(5), ":", "")
    offset = F.when(digits.isin("", "Z"), F.lit("+00:00")).otherwise(F.concat(F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0")))
    whole = F.concat(part(1), F.lit(" "), or_else(2, "00:00"), F.lit(":"), or_else(3, "00"), F.lit("."), F.rpad(F.substring(or_else(4, "0"), 1, 6), 6, "0"), offset)
    return F.when(part(1) != "", whole.try_cast("timestamp"))


def age_days(text: Column, as_of: Column) -> Column:
    """Whole days from an ISO date to another date; null for a text that is none."""
    return F.datediff(as_of, iso_time(text).cast("date"))
