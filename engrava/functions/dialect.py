"""Column forms of the embedded SQL dialect where Spark's own differ."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from engrava.functions.instants import parse_instant


def datetime_text(value: Column, unixepoch: bool = False) -> Column:
    """``datetime(x)``: UTC text to the second; NULL for what is no time. With unixepoch the value is seconds."""
    t = F.timestamp_seconds(value) if unixepoch else parse_instant(value)
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def truthy(value: Column, kind: str) -> Column:
    """0, '' and an empty blob are false; NULL stays NULL."""
    if kind in ("string", "binary"):
        return F.length(value) > 0
    if kind == "boolean":
        return value
    return value != 0


def like_ascii(value: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only; % and _, no escape."""
    fold = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.like(fold(value), fold(F.lit(pattern)))


def equals_as_text(value: Column, number) -> Column:
    """A text column compared with a numeric literal: as text, so that '05' is not 5."""
    return value == F.lit(str(number))


def storage_class(number: Column | None = None, text: Column | None = None, blob: Column | None = None) -> Column:
    """A cell of any class as a struct that sorts as the dialect does: NULL, numbers, text, blobs."""
    none = F.lit(None)
    n = none.cast("double") if number is None else number.cast("double")
    t = none.cast("string") if text is None else text
    b = none.cast("binary") if blob is None else blob
    rank = F.when(n.isNotNull(), 1).when(t.isNotNull(), 2).when(b.isNotNull(), 3).otherwise(0)
    return F.struct(rank.alias("rank"), n.alias("n"), t.alias("t"), F.hex(b).alias("b"))


def typed_less(a: Column, b: Column) -> Column:
    """a < b for two ``storage_class`` cells; NULL if either is NULL; numeric text against a number counts as number."""
    as_n = lambda x: F.when(x["rank"] == 2, x["t"].try_cast("double")).otherwise(x["n"])
    numeric = ((a["rank"] == 1) | (b["rank"] == 1)) & as_n(a).isNotNull() & as_n(b).isNotNull()
    same = F.when(a["rank"] == 1, a["n"] < b["n"]).when(a["rank"] == 2, a["t"] < b["t"]).otherwise(a["b"] < b["b"])
    return F.when((a["rank"] == 0) | (b["rank"] == 0), F.lit(None).cast("boolean")).when(numeric, as_n(a) < as_n(b)).when(a["rank"] == b["rank"], same).otherwise(a["rank"] < b["rank"])


def affinity(value: Column, kind: str) -> Column:
    """Coercion on write: INTEGER takes whole numbers, REAL numbers; what doesn't convert is NULL here."""
    if kind == "INTEGER":
        d = value.try_cast("double")
        return F.when(d == F.floor(d), d.cast("long"))
    if kind == "REAL":
        return value.try_cast("double")
    return value.cast("string")
