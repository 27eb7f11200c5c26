"""Text to instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)?$"
_OFFSET = r"([Zz]|[+-]\d{2}(:?\d{2})?)$"


def parse_instant(text: Column) -> Column:
    """ISO text to TIMESTAMP; without an offset it is UTC, whatever the session's zone. Anything else is NULL."""
    s = F.trim(text)
    has_time = F.length(s) > 10
    offset = F.regexp_extract(F.substring(s, 11, 40), _OFFSET, 1)
    zoned = F.when(has_time & (offset != ""), F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")).when(has_time, F.concat(s, F.lit("Z"))).otherwise(F.concat(s, F.lit("T00:00:00Z")))
    return F.when(s.rlike(_SHAPE), zoned.try_cast("timestamp"))


def blank(text: Column) -> Column:
    """True where the text is null, empty or only white space."""
    return text.isNull() | text.rlike(r"^\s*$")
