"""Calendar fields by which roll-ups group, all in UTC."""

from pyspark.sql import Column, functions as F

HALF_DAY_MS = 43_200_000

# Length in ms of the units whose boundaries are equidistant; None = variable.
UNIT_MS = {
    "year": None, "month": None, "day_of_month": 86_400_000, "am_pm": HALF_DAY_MS,
    "hour": 3_600_000, "hour_of_day": 3_600_000, "minute": 60_000, "second": 1_000,
}
UNITS = tuple(UNIT_MS)


def calendar_key(unit: str, ts: Column) -> Column:
    """The field of `ts`; months count from 0, hours of the half day from 0 to 11."""
    fields = {
        "year": lambda: F.year(ts),
        "month": lambda: F.month(ts) - 1,
        "day_of_month": lambda: F.dayofmonth(ts),
        "am_pm": lambda: F.floor(F.hour(ts) / 12),
        "hour": lambda: F.hour(ts) % 12,
        "hour_of_day": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts),
        "second": lambda: F.second(ts),
    }
    if unit not in fields:
        raise ValueError(f"unknown calendar unit {unit!r}")
    return fields[unit]().cast("int")


def calendar_unit(unit: str, ts: Column) -> Column:
    """Start of the unit that `ts` falls into."""
    if UNIT_MS[unit] is None:
        return F.date_trunc(unit, ts)
    return F.floor(F.unix_millis(ts) / UNIT_MS[unit])
