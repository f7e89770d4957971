"""Clock and calendar algebra in whole minutes (FN-01 to FN-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440

#: Period names by three-hour slot, and by quarter of the day.
PERIODS = ["Late_Night", "Early_Morning", "Morning", "Late_Morning", "Early_Afternoon", "Late_Afternoon", "Evening", "Night"]
QUARTERS = ["Night", "Morning", "Afternoon", "Evening"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("int")


def valid_hhmm(c: str | Column) -> Column:
    """Whether an HHmm number or text is a time of day."""
    n = F.expr(f"try_cast(`{c}` AS INT)") if isinstance(c, str) else c.try_cast("int")
    return F.coalesce(n.between(0, 2359) & (n % 100 < 60), F.lit(False))


def hhmm_to_minutes(c: str | Column) -> Column:
    """Minutes since midnight of HHmm; null if that isn't a time of day."""
    n = _c(c).cast("string").try_cast("int")
    return F.when(n.between(0, 2359) & (n % 100 < 60), _div(n, 100) * 60 + n % 100)


def minutes_to_hhmm(c: str | Column) -> Column:
    """Four digits of minutes since midnight, taken around the clock."""
    m = F.pmod(_c(c), F.lit(DAY)).cast("int")
    return F.format_string("%02d%02d", _div(m, 60), m % 60)


def day_carry(minutes: str | Column) -> Column:
    return _div(_c(minutes), DAY)


def to_utc(date: str, hhmm: str, offset_hours: str | Column, prefix: str = "utc") -> dict[str, Column]:
    """FN-01: local date and HHmm less the offset, carried over midnight."""
    m = hhmm_to_minutes(hhmm) - (_c(offset_hours) * 60).cast("int")
    return {f"{prefix}_time": F.when(m.isNotNull(), minutes_to_hhmm(m)), f"{prefix}_date": F.date_add(F.col(date), day_carry(m))}


def from_utc(date: str, hhmm: str, offset_hours: str | Column, prefix: str = "local") -> dict[str, Column]:
    """FN-03: UTC date and HHmm to local ones."""
    return to_utc(date, hhmm, -_c(offset_hours), prefix)


def add_duration(date: str, hhmm: str, minutes: str, prefix: str = "arr") -> dict[str, Column]:
    """FN-02, FN-07: HHmm plus a duration: time, date, parts, days crossed."""
    total = hhmm_to_minutes(hhmm) + F.round(_c(minutes)).cast("int")
    of_day = F.pmod(total, F.lit(DAY)).cast("int")
    return {
        f"{prefix}_time": F.when(total.isNotNull(), minutes_to_hhmm(total)),
        f"{prefix}_date": F.date_add(F.col(date), day_carry(total)),
        f"{prefix}_minutes": of_day,
        f"{prefix}_hour": _div(of_day, 60),
        f"{prefix}_minute": of_day % 60,
        f"{prefix}_hour_decimal": of_day / F.lit(60.0),
        f"{prefix}_hour_rounded": _rounded(of_day),
        f"{prefix}_crosses_midnight": (total >= DAY).cast("int"),
        f"{prefix}_days_span": day_carry(total),
    }


def arrival_flags(local: str, utc: str, dep_date: str, arr_date: str, dep_offset: str, arr_offset: str, dep_local: str, dep_utc: str) -> dict[str, Column]:
    """FN-04: parts of an arrival in local time and UTC, and how it lies to the departure."""
    m, u = hhmm_to_minutes(local), hhmm_to_minutes(utc)
    return {
        "arrival_hour": _div(m, 60),
        "utc_arrival_hour": _div(u, 60),
        "arrival_hour_floor": F.format_string("%02d00", _div(m, 60)),
        "arrival_period": period(m),
        "crosses_midnight_local": (m < hhmm_to_minutes(dep_local)).cast("int"),
        "crosses_midnight_utc": (u < hhmm_to_minutes(dep_utc)).cast("int"),
        "arrival_day_span": F.datediff(arr_date, dep_date),
        "zone_difference": F.col(arr_offset) - F.col(dep_offset),
        "is_eastward": (F.col(arr_offset) > F.col(dep_offset)).cast("int"),
        "is_westward": (F.col(arr_offset) < F.col(dep_offset)).cast("int"),
    }


def period(minutes: Column) -> Column:
    """The three-hour slot's name."""
    return F.element_at(F.array(*map(F.lit, PERIODS)), _div(minutes, 180) + 1)


def calendar_parts(c: str | Column) -> dict[str, Column]:
    """FN-05 of a date or timestamp."""
    d = _c(c)
    return {
        "year": F.year(d), "month": F.month(d), "quarter": F.quarter(d), "quarter_name": F.concat(F.lit("Q"), F.quarter(d).cast("string")),
        "day_of_month": F.dayofmonth(d), "day_of_week": F.dayofweek(d), "day_of_year": F.dayofyear(d), "week_of_year": F.weekofyear(d),
    }


def clock_parts(minutes: str | Column, prefix: str = "dep") -> dict[str, Column]:
    """FN-06 of minutes since midnight."""
    m = _c(minutes).cast("int")
    return {
        f"{prefix}_hour": _div(m, 60),
        f"{prefix}_minute": m % 60,
        f"{prefix}_hour_decimal": m / F.lit(60.0),
        f"{prefix}_quarter_day": _div(m, 360),
        f"{prefix}_quarter_name": F.element_at(F.array(*map(F.lit, QUARTERS)), _div(m, 360) + 1),
        f"{prefix}_period": period(m),
        f"{prefix}_minutes": m,
        f"{prefix}_hour_rounded": _rounded(m),
    }


def _rounded(minutes: Column) -> Column:
    return F.pmod(_div(minutes + 30, 60), F.lit(24)).cast("int")


def round_to_hour(hhmm: str | Column, as_hour: bool = False) -> Column:
    """FN-08: the nearest whole hour as HH00 (a number), or as the hour; 23:30 and later is 0."""
    h = _rounded(hhmm_to_minutes(hhmm))
    return h if as_hour else h * 100


def hour_of(c: str | Column) -> Column:
    """JOIN-06: hour 0 to 23 of ``HHmm`` or ``HH:mm`` text or an HHmm number."""
    digits = F.lpad(F.regexp_replace(_c(c).cast("string"), ":", ""), 4, "0")
    return F.substring(digits, 1, 2).try_cast("int") % 24


def date_and_hour(date: str | Column, hour: str | Column) -> Column:
    """FN-09: the timestamp of a date and an hour."""
    return _c(date).cast("timestamp") + F.make_dt_interval(hours=_c(hour).cast("int"))


#: Date formats tried in turn.
DATE_FORMATS = ["yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy"]


def parse_date(c: str | Column, formats: list[str] = DATE_FORMATS) -> Column:
    """FN-10: the date by the first format that parses, else null."""
    return F.coalesce(*[F.try_to_timestamp(_c(c), F.lit(f)).cast("date") for f in formats])


def date_features(c: str, timestamp: bool = False) -> dict[str, Column]:
    """FN-11: parts of a date as doubles for a feature vector."""
    parts = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "weekday": F.dayofweek(c), "unix": F.unix_timestamp(F.col(c).cast("timestamp"))}
    if timestamp:
        parts |= {"hour": F.hour(c), "minute": F.minute(c)}
    return {f"{c}_{k}": v.cast("double") for k, v in parts.items()}


def month_key(c: str | Column) -> Column:
    """FN-12: ``yyyy-MM``."""
    return F.date_format(_c(c), "yyyy-MM")
