"""Delimited text with quoted fields, taken apart by built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a separator inside quotes while a line is cut; a private-use character no exchange format assigns.
MASK = ""


def _segments(raw: Column) -> Column:
    return F.split(raw, '"', -1)


def quoting_broken(raw: Column, delim: Column) -> Column:
    """True if a double quote stands anywhere but around a whole field or doubled inside such a field, or one stays open.

    Cut at the quotes, the parts at even places are outside quotes. Between two quotes such a part is either empty
    (a doubled quote) or begins and ends with the separator; the first one ends and the last one begins with it.
    """
    seg = _segments(raw)
    n = F.size(seg)

    def wrong(s: Column, i: Column) -> Column:
        left = (i == 0) | (s == "") | s.startswith(delim)
        right = (i == n - 1) | (s == "") | s.endswith(delim)
        return F.when((i % 2 == 1) | (n == 1), F.lit(False)).otherwise(~(left & right))

    flags = F.transform(seg, wrong)
    return (n % 2 == 0) | F.exists(flags, lambda x: x)


def fields(raw: Column, delim: Column) -> Column:
    """The fields as written, with their quotes, separators inside quotes masked. Meant for lines whose quoting is sound."""
    masked = F.transform(_segments(raw), lambda s, i: F.when(i % 2 == 1, F.replace(s, delim, F.lit(MASK))).otherwise(s))
    return F.split(F.array_join(masked, '"'), F.concat(F.lit("\\Q"), delim, F.lit("\\E")), -1)


def unquoted(field: Column, delim: Column) -> Column:
    """The value of a field of fields()."""
    inner = F.when(
        field.startswith('"') & (F.length(field) >= 2), F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(field)
    return F.replace(inner, F.lit(MASK), delim)


def header_names(raw: Column, delim: Column) -> Column:
    """Header names without quotes and outer blanks."""
    return F.transform(fields(raw, delim), lambda f: F.trim(unquoted(F.trim(f), delim)))
