"""Calendar arithmetic as Column expressions; no parsing functions, so nothing raises under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return (
        F.when(m == 2, F.when(leap, F.lit(29)).otherwise(F.lit(28)))
        .when(m.isin(4, 6, 9, 11), F.lit(30))
        .when((m >= 1) & (m <= 12), F.lit(31))
        .otherwise(F.lit(0))
    )


def is_calendar_day(y: Column, m: Column, d: Column) -> Column:
    """True, false, or null if a part is null. Years 1 to 9999."""
    return (y >= 1) & (y <= 9999) & (d >= 1) & (d <= days_in_month(y, m))


def epoch_day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integer arithmetic (bigint)."""
    y, m, d = (c.cast("bigint") for c in (y, m, d))
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def to_int(c: Column) -> Column:
    return c.try_cast("int")
