"""Flags, buckets, cyclic encodings, horizontal aggregates and labels (FN-20 to FN-28, LBL)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, also where it is null."""
    return F.when(condition, 1).otherwise(0)


def cyclic(c: str | Column, period: float, name: str, start: int = 0, sin: bool = True, cos: bool = True) -> dict[str, Column]:
    """FN-20, FN-21: sine and cosine of a value's place in its period."""
    angle = ((F.col(c) if isinstance(c, str) else c) - start) * F.lit(2 * math.pi / period)
    return ({f"{name}_sin": F.sin(angle)} if sin else {}) | ({f"{name}_cos": F.cos(angle)} if cos else {})


def period_flags(month: str, day: str, weekday: str, hour: str) -> dict[str, Column]:
    """FN-22; weekday 1 is Sunday."""
    m, d, w, h = map(F.col, (month, day, weekday, hour))
    return {
        "is_weekend": flag(w.isin(1, 7)), "is_friday": flag(w == 6), "is_monday": flag(w == 2),
        "is_summer": flag(m.isin(6, 7, 8)), "is_winter": flag(m.isin(12, 1, 2)), "is_spring": flag(m.isin(3, 4, 5)), "is_fall": flag(m.isin(9, 10, 11)),
        "is_holiday_season": flag(m.isin(11, 12, 1, 7) | ((m == 3) & d.between(15, 31))),
        "is_early_morning": flag(h.between(5, 7)), "is_morning_rush": flag(h.between(6, 9)), "is_business_hours": flag(h.between(9, 17)),
        "is_evening_rush": flag(h.between(17, 20)), "is_night": flag((h >= 22) | (h <= 5)),
        "is_month_start": flag(d <= 5), "is_month_end": flag(d >= 26),
        "is_extended_weekend": flag(((w == 6) & (h <= 12)) | ((w == 1) & (h >= 18))),
    }


def buckets(c: str | Column, bounds: list[tuple[float, str]], other: str, strict: bool = False) -> Column:
    """The name of the first bound that the value doesn't exceed (``strict``: is below), else ``other``."""
    v = F.col(c) if isinstance(c, str) else c
    return reduce(lambda acc, b: acc.when(v < b[0] if strict else v <= b[0], b[1]), bounds[1:], F.when(v < bounds[0][0] if strict else v <= bounds[0][0], bounds[0][1])).otherwise(other)


def at_least(c: str | Column, bounds: list[tuple[float, str]], other: str) -> Column:
    """FN-25: the name of the first bound that the value reaches, else ``other``."""
    v = F.col(c) if isinstance(c, str) else c
    return reduce(lambda acc, b: acc.when(v >= b[0], b[1]), bounds[1:], F.when(v >= bounds[0][0], bounds[0][1])).otherwise(other)


def undirected(a: str, b: str) -> Column:
    """An id of the pair of two keys, whatever their order."""
    return F.concat_ws("_", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def trip_features(duration: str, carrier: str, number: str, origin: str, dest: str, date: str) -> dict[str, Column]:
    """FN-23."""
    return {
        "unique_id": F.concat_ws("_", *[F.col(c).cast("string") for c in (date, carrier, number, origin, dest)]),
        "distance_category": buckets(duration, [(90, "short"), (240, "medium"), (360, "long")], "very_long"),
        "distance_score": F.least(F.col(duration) / 600.0, F.lit(1.0)),
        "is_likely_domestic": flag(F.col(duration) <= 360),
        "carrier_hash": F.hash(carrier),
        "route_id": undirected(origin, dest),
        "is_roundtrip_candidate": flag(F.col(duration) <= 180),
    }


#: Ids of the main hubs.
HUBS = [10397, 11298, 12266, 13930, 14107, 14771, 15016]


def place_features(origin: str, dest: str, hubs: list[int] = HUBS) -> dict[str, Column]:
    """FN-24."""
    o, d = F.col(origin), F.col(dest)
    return {
        "origin_is_hub": flag(o.isin(hubs)), "dest_is_hub": flag(d.isin(hubs)),
        "origin_complexity": (o % 100) / 100.0, "dest_complexity": (d % 100) / 100.0,
        "zone_proxy": F.abs(o % 10 - d % 10), "is_eastbound": flag(d > o), "is_westbound": flag(o > d),
        "is_hub_to_hub": flag(o.isin(hubs) & d.isin(hubs)),
    }


def popularity(route: str, carrier: str) -> dict[str, Column]:
    """FN-25 on the counts of WIN-01."""
    return {
        "route_popularity": at_least(route, [(100, "high"), (20, "medium")], "low"),
        "carrier_size": at_least(carrier, [(1000, "major"), (100, "medium")], "small"),
    }


def _mean(values: list[Column]) -> Column:
    return sum(values[1:], values[0]) / F.lit(float(len(values)))


def horizontal(columns: list[str], method: str, default: float = 0.0) -> Column:
    """FN-26: an aggregate across columns of a row, nulls as ``default``: sum, avg, max, min, std
    (population), range, slope. Columns run from the most recent hour back; the slope is chronological,
    per step."""
    v = [F.coalesce(F.col(c).cast("double"), F.lit(default)) for c in columns]
    many = len(v) > 1
    top, low = (F.greatest(*v), F.least(*v)) if many else (v[0], v[0])
    known = {
        "sum": lambda: sum(v[1:], v[0]),
        "avg": lambda: _mean(v),
        "max": lambda: top,
        "min": lambda: low,
        "std": lambda: F.sqrt(_mean([(x - _mean(v)) * (x - _mean(v)) for x in v])),
        "range": lambda: top - low,
        "slope": lambda: (v[0] - v[-1]) / F.lit(float(max(1, len(v) - 1))),
    }
    name = {"mean": "avg", "stddev": "std", "trend": "slope"}.get(method.lower(), method.lower())
    if name not in known:
        raise ValueError(f"unknown aggregate {method!r}")
    return known[name]()


def trends(columns: list[str], name: str, level: float = 0.1) -> dict[str, Column]:
    """FN-27 over three or more hour columns, most recent first: slope, spread, direction, and with six or
    more the acceleration (slope of the recent half less that of the older)."""
    if len(columns) < 3:
        raise ValueError("a trend needs three points")
    slope = horizontal(columns, "slope")
    out = {
        f"{name}_trend_slope": slope,
        f"{name}_trend_spread": horizontal(columns, "std"),
        f"{name}_trend_direction": F.when(slope < -level, -1).when(slope > level, 1).otherwise(0),
    }
    if len(columns) >= 6:
        half = len(columns) // 2
        out[f"{name}_trend_acceleration"] = horizontal(columns[:half], "slope") - horizontal(columns[-half:], "slope")
    return out


def critical_trends(visibility: list[str], temperature: list[str], humidity: list[str]) -> dict[str, Column]:
    """FN-28, columns most recent first: visibility falling by more than 5; icing developing (temperature
    falls by more than 2 to below 5 while humidity rises by more than 10)."""
    now = lambda cs, d: F.coalesce(F.col(cs[0]), F.lit(d))
    change = lambda cs, d: now(cs, d) - F.coalesce(F.col(cs[-1]), F.lit(d))
    return {
        "visibility_deteriorating_fast": flag(change(visibility, 10.0) < -5.0),
        "icing_conditions_developing": flag((change(temperature, 15.0) < -2.0) & (change(humidity, 50.0) > 10.0) & (F.col(temperature[0]) < 5.0)),
    }


# labels

THRESHOLDS = [15, 30, 45, 60, 90]


def dataset_flags(total: str, weather: str, nas: str, thresholds: list[int] = THRESHOLDS, close: float = 0.05) -> dict[str, Column]:
    """LBL-01: D1 the delay is explained by weather and system causes; D2_t weather, or system at t or
    more; D3 either; D4 any delay."""
    t, w, n = (F.coalesce(F.col(c), F.lit(0.0)) for c in (total, weather, nas))
    near = lambda x: F.abs(t - x) <= close + 1e-9
    return {
        "D1": flag((t > 0) & (near(w + n) | near(w) | near(n))),
        **{f"D2_{k}": flag((w > 0) | (n >= k)) for k in thresholds},
        "D3": flag((w > 0) | (n > 0)),
        "D4": flag(t > 0),
    }


def threshold_flags(c: str | Column, name: str, thresholds: list[int] = THRESHOLDS) -> dict[str, Column]:
    """LBL-06 for several thresholds."""
    v = F.col(c) if isinstance(c, str) else c
    return {f"{name}_{t}": flag(v >= t) for t in thresholds}


def delay_labels(total: str, weather: str, nas: str, thresholds: list[int] = THRESHOLDS) -> dict[str, Column]:
    """LBL-03."""
    t, w, n = (F.coalesce(F.col(c), F.lit(0.0)) for c in (total, weather, nas))
    return {
        **{f"{k}_filled": v for k, v in (("total", t), ("weather", w), ("nas", n))},
        **{f"{k}_was_missing": flag(F.col(c).isNull()) for k, c in (("total", total), ("weather", weather), ("nas", nas))},
        **threshold_flags(t, "is_delayed", thresholds),
        "has_weather_delay": flag(w > 0), "has_nas_delay": flag(n > 0), "weather_nas_total": w + n, "is_on_time": flag(t <= 0), "is_early": flag(t < 0),
    }


def delay_targets(total: str, weather: str, nas: str, thresholds: list[int] = THRESHOLDS) -> dict[str, Column]:
    """LBL-04: four targets, each with its thresholds, and the default ``label``."""
    t, w, n = (F.coalesce(F.col(c), F.lit(0.0)) for c in (total, weather, nas))
    targets = {
        "weather_only": w,
        "weather_nas": w + n,
        "total": t,
        "weather_related": F.when(w > 0, w + n * 0.5).otherwise(F.when(n > 30, n * 0.3).otherwise(0.0)),
    }
    out = {f"{k}_delay": v for k, v in targets.items()}
    for k, v in targets.items():
        out |= threshold_flags(v, f"is_{k}_delayed", thresholds)
    return out | {"label": flag(w + n >= thresholds[0])}


def severity(c: Column) -> Column:
    return at_least(c, [(90, "critical"), (60, "severe"), (30, "moderate"), (15, "minor")], "none")


def delay_explanations(total: str, weather: str, nas: str) -> dict[str, Column]:
    """LBL-05."""
    t, w, n = (F.coalesce(F.col(c), F.lit(0.0)) for c in (total, weather, nas))
    share = lambda x: F.when(t > 0, x / t * 100).otherwise(0.0)
    return {
        "weather_contribution_pct": share(w),
        "nas_contribution_pct": share(n),
        "cascading_score": F.when(w > 0, n / (w + 1)).otherwise(0.0),
        "dominant_delay_type": F.when(w >= n, "weather").when(n > 0, "nas").otherwise("other"),
        "is_mixed_delay": flag((w > 0) & (n > 0)),
        "delay_severity": severity(t),
    }
