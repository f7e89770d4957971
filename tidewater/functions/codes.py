"""Features of coded text: sky layers, weather groups, visibility, pressure (FN-40 to FN-54)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.flags import buckets, flag
from tidewater.operators.ranks import values_at

NO_CEILING = 99999

#: Sky codes from the worst, with their risk.
SKY = [("VV", 5.0), ("OVC", 4.0), ("BKN", 3.0), ("SCT", 2.0), ("FEW", 1.0), ("CLR", 0.0), ("SKC", 0.0)]

#: Weather groups by flag.
GROUPS = {
    "thunderstorm": ["TS"],
    "freezing_precip": ["FZRA", "FZDZ", "FZFG", "FZBR"],
    "freezing": ["FZ"],
    "precipitation": ["RA", "DZ", "SN", "GR", "GS", "PL", "SG", "IC", "UP"],
    "obscuration": ["BR", "FG", "FU", "HZ", "DU", "SA", "VA"],
    "visible_moisture": ["RA", "DZ", "FG", "BR", "SH"],
    "hazardous": ["DS", "SS", "FC", "SQ", "PO", "TS", "FZ"],
    "rain": ["RA"],
    "snow": ["SN"],
    "drizzle": ["DZ"],
    "fog_mist": ["FG", "BR"],
    "hail": ["GR", "GS"],
}

#: Present-weather codes by type and by intensity.
WEATHER_TYPES = {
    "Rain": [21, 60, 61, 62, 63, 64, 65],
    "Freezing_Precip": [24, 56, 57, 66, 67],
    "Drizzle": [20, 50, 51, 52, 53, 54, 55],
    "Snow": [22, 70, 71, 72, 73, 74, 75],
    "Rain_Snow_Mix": [23, 68, 69],
    "Shower": [25, 26, 80, 81, 82, 83, 84, 85, 86],
    "Thunderstorm": [17, 29, 95, 96, 97, 99],
    "Fog_Mist": [10, 28, 40, 41, 42, 43, 44, 45],
    "Haze": [5],
    "Squall": [18],
    "Dust_Sand": [30, 31, 32, 33, 34, 35],
    "Blowing_Snow": [36, 37, 38, 39],
}
WEATHER_INTENSITIES = {
    "Light": [50, 51, 60, 61, 70, 71, 80, 83, 85],
    "Moderate": [52, 53, 62, 63, 72, 73, 81, 84, 86],
    "Heavy": [54, 55, 64, 65, 74, 75, 82, 87, 88, 97, 99],
}


def _has(c: Column, codes: list[str]) -> Column:
    return c.rlike("|".join(codes))


def sky_features(c: str) -> dict[str, Column]:
    """FN-40, FN-41: worst code, layers, risk, presence flags, cloud heights and ceiling in feet."""
    s = F.col(c)
    blank = s.isNull() | (F.trim(s) == "")
    worst = reduce(lambda acc, x: acc.when(s.contains(x[0]), "CLR" if x[0] == "SKC" else x[0]), SKY, F.when(blank, "UNKNOWN")).otherwise("UNKNOWN")
    risk = reduce(lambda acc, x: acc.when(s.contains(x[0]), x[1]), SKY, F.when(blank, 1.0)).otherwise(2.0)
    heights = lambda codes: F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(rf"({codes})(\d{{3}})"), F.lit(2)), lambda x: x.cast("int") * 100)
    lowest = lambda a: F.coalesce(F.array_min(a), F.lit(NO_CEILING))
    ceiling = F.when(s.contains("VV"), 0).otherwise(lowest(heights("BKN|OVC")))
    return {
        "most_critical_sky": worst,
        "num_cloud_layers": F.when(blank, 0).otherwise(F.size(F.split(F.trim(s), r"\s+"))),
        "cloud_risk_score": risk,
        "has_overcast": flag(s.contains("OVC")), "has_broken": flag(s.contains("BKN")), "has_obscured": flag(s.contains("VV")), "is_clear": flag(_has(s, ["CLR", "SKC"])),
        "lowest_cloud_height": lowest(heights("FEW|SCT|BKN|OVC")),
        "ceiling": ceiling,
        "has_low_ceiling": flag(ceiling < 1000),
    }


def weather_type_features(c: str) -> dict[str, Column]:
    """FN-42."""
    s = F.col(c)
    heavy, light = s.startswith("+"), s.startswith("-")
    has = {k: _has(s, codes) for k, codes in GROUPS.items()}
    return {
        "intensity_heavy": flag(heavy), "intensity_light": flag(light),
        "weather_intensity": F.when(heavy, "heavy").when(light, "light").otherwise("moderate"),
        "precipitation_intensity": F.when(heavy, 1).when(light, -1).otherwise(0),
        **{f"has_{k}": flag(v) for k, v in has.items()},
        "extracted_codes": F.regexp_replace(s, "^[+-]", ""),
        "hazard_level": F.when(has["freezing_precip"] | has["thunderstorm"], 3).when(has["hazardous"] | (heavy & has["precipitation"]), 2)
        .when(has["precipitation"] | has["obscuration"], 1).otherwise(0),
    }


#: Pairs of weather codes that count as one when a group begins with them.
COMPOSITES = [
    "TSRA", "TSSN", "TSDZ", "TSPL", "TSGR", "TSGS", "SHRA", "SHSN", "SHGR", "SHGS", "FZRA", "FZDZ", "FZFG", "FZBR", "BLSN", "BLDU", "BLSA", "DRDU", "DRSA", "DRSN",
    "BCFG", "MIFG", "PRFG", "VCFG", "VCSH", "VCTS", "RAGR", "RAGS", "RASN", "RAPL", "SNRA", "SNPL", "SNGS", "PLRA", "PLSN", "GSRA", "GRRA",
]


def weather_code_set(c: str) -> Column:
    """UDF-03: the distinct codes of a weather text, sorted: of each group between blanks (without a sign before the
    first) its letters two by two, pairs that aren't two letters left out, and the composite that it begins with, if it
    does. Null, blank and odd single letters have none."""
    groups = F.split(F.trim(F.upper(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^[+-]", ""))), r"\s+")
    pairs = lambda g: F.filter(F.regexp_extract_all(g, F.lit("(..)")), lambda x: x.rlike("^[A-Z]{2}$"))
    whole = lambda g: F.filter(F.array(F.substring(g, 1, 4)), lambda x: x.isin(COMPOSITES))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.concat(whole(g), pairs(g))))))


def weather_conditions(c: str) -> dict[str, Column]:
    """UDF-03: the old parser's view of a weather text: intensity by the sign, and flags by its codes."""
    codes, s = weather_code_set(c), F.trim(F.col(c))
    any_of = lambda *some: flag(F.arrays_overlap(codes, F.array(*map(F.lit, some))))
    return {
        "parsed_codes": codes, "parsed_intensity": F.when(s.startswith("+"), "HEAVY").when(s.startswith("-"), "LIGHT").otherwise("MODERATE"),
        "parsed_thunderstorm": any_of("TS"), "parsed_freezing": any_of("FZ", "FZRA", "FZDZ", "FZFG", "FZBR"), "parsed_precipitation": any_of(*GROUPS["precipitation"]),
        "parsed_obscuration": any_of(*GROUPS["obscuration"], "PY"), "parsed_hazard": any_of("DS", "SS", "FC", "SQ", "PO"),
    }


def icing_features(weather: str, temperature: str, dew_point: str) -> dict[str, Column]:
    """FN-43."""
    s, t = F.col(weather), F.col(temperature)
    spread = t - F.col(dew_point)
    freezing, moist = _has(s, GROUPS["freezing_precip"]), F.coalesce(_has(s, ["RA", "DZ", "FG", "BR", "SN"]), F.lit(False))
    damp = lambda most: F.coalesce(spread <= most, F.lit(False))
    return {
        "icing_risk_flag": F.when(freezing, 1).when(t.between(-15.0, 2.0) & (damp(3.0) | moist), 1).otherwise(0),
        "icing_risk_level": F.when(freezing, 3).when(t.between(-10.0, 0.0) & moist & damp(2.0), 2).when(t.between(-15.0, 2.0) & (damp(3.0) | moist), 1).otherwise(0),
    }


def visibility_features(c: str, unit_divisor: float = 1.0, cap: float = 10.0) -> dict[str, Column]:
    """FN-44 of a number or text; missing (``M``, blank, not a number) counts as the cap."""
    v = F.coalesce(F.least(F.trim(F.col(c).cast("string")).try_cast("double") / unit_divisor, F.lit(cap)), F.lit(cap))
    return {
        "visibility_miles": v,
        "visibility_km": v * 1.609,
        "visibility_category": buckets(v, [(0.5, "LIFR"), (1.0, "IFR_LOW"), (3.0, "IFR"), (5.0, "MVFR"), (10.0, "VFR")], "VFR_HIGH", strict=True),
        "visibility_risk_score": F.when(v < 0.5, 5.0).when(v < 1, 4.0).when(v < 3, 3.0).when(v < 5, 2.0).when(v < 10, 1.0).otherwise(0.0),
        "is_low_visibility": flag(v < 3), "is_very_low_visibility": flag(v < 1),
        "visibility_normalized": F.when(v > 0, v / 10.0).otherwise(0.0),
        "visibility_inverse": F.when(v > 0, 1.0 / v).otherwise(10.0),
    }


def conditions(visibility: str, ceiling: str, cloud_risk: str, visibility_risk: str, obscured: str) -> dict[str, Column]:
    """FN-45, FN-46, FN-53: severity index, flight rules, risk level, category and its extras."""
    v, h = F.col(visibility), F.col(ceiling)
    penalty = F.when(h < 500, 2.0).when(h < 1000, 1.0).otherwise(0.0) + F.when(v < 0.5, 2.0).when(v < 1.0, 1.0).otherwise(0.0)
    category = F.when((v < 1) | (h < 500), "LIFR").when((v < 3) | (h < 1000), "IFR").when((v <= 5) | (h <= 3000), "MVFR").otherwise("VFR")
    ordinal = F.when((v < 1) | (h < 500), 3).when((v < 3) | (h < 1000), 2).when((v <= 5) | (h <= 3000), 1).otherwise(0)
    return {
        "weather_severity_index": F.least(F.col(cloud_risk) * 0.4 + F.col(visibility_risk) * 0.6 + penalty, F.lit(10.0)),
        "is_vfr": flag((v >= 5) & (h >= 3000)), "is_ifr": flag((v < 3) | (h < 1000)), "requires_cat_ii": flag((v < 1) | (h < 200)),
        "operations_risk_level": F.when((F.col(obscured) == 1) | (v < 0.25) | (h < 100), 4).when((v < 1) | (h < 500), 3).when((v < 3) | (h < 1000), 2)
        .when((v < 5) | (h < 3000), 1).otherwise(0),
        "flight_category": category,
        "flight_category_ordinal": ordinal,
        **{f"is_category_{k.lower()}": flag(category == k) for k in ("LIFR", "IFR", "MVFR", "VFR")},
        "flight_category_severity": F.element_at(F.array(*map(F.lit, ("none", "low", "moderate", "severe"))), ordinal + 1),
        "needs_instrument_procedure": flag(ordinal >= 2),
    }


def lookup(c: Column | str, table: dict[str, list], default: str) -> Column:
    """FN-47: the name whose list holds the value, else the default."""
    pairs = [F.lit(x) for name, values in table.items() for v in values for x in (v, name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(c) if isinstance(c, str) else c), F.lit(default))


def present_weather(c: str) -> dict[str, Column]:
    code = F.col(c).cast("string").try_cast("int")
    known = lambda table, other: F.when(code.isNull(), other).otherwise(lookup(F.coalesce(code, F.lit(-1)), table, other))
    return {"weather_type": known(WEATHER_TYPES, "Clear_or_Other"), "weather_intensity_name": known(WEATHER_INTENSITIES, "Not_Applicable")}


def spread(a: str, b: str) -> Column:
    """FN-48."""
    return F.col(a) - F.col(b)


def pressure_features(tendency: str, change: str) -> dict[str, Column]:
    """FN-49."""
    t, c = F.col(tendency), F.col(change).cast("string").try_cast("double")
    return {
        "pressure_trend_sign": F.when(t.isin("1", "2", "3"), 1).when(t.isin("4", "5", "6", "7", "8"), -1).when(t == "0", 0),
        "pressure_change": c,
        "pressure_change_abs": F.abs(c),
        "pressure_variation_risk": flag(F.abs(c) > 20),
        "pressure_dropping_fast": flag(c <= -2),
        "pressure_bucket": F.when(c.isNull(), "unknown").otherwise(buckets(F.abs(c), [(9, "stable"), (20, "transition")], "disturbed")),
    }


class QuantileBins:
    """FN-50: four bins by quartiles, fitted on one frame (the training set) and applied to any. Each cut is a value of the column,
    the one at rank ceil(share * n) from 1: within the relative error, or, without one (None or 0), exactly."""

    NAMES = ["low", "moderate", "high", "very_high"]

    def __init__(self, relative_error: float | None = 1e-3):
        self.error, self.cuts = relative_error, None

    def fit(self, df: DataFrame, c: str) -> QuantileBins:
        shares = [0.25, 0.5, 0.75]
        if self.error:
            found = df.agg(F.percentile_approx(c, F.array(*map(F.lit, shares)), F.lit(int(1 / self.error))).alias("q")).first()["q"]
        else:
            at = values_at(df, c, shares=shares, between=False)
            found = [at[p] for p in shares] if at else None
        self.cuts = found or [0.0, 0.0, 0.0]
        return self

    def column(self, c: str | Column) -> Column:
        v = F.col(c) if isinstance(c, str) else c
        return F.when(v.isNull(), self.NAMES[0]).otherwise(buckets(v, list(zip(self.cuts, self.NAMES, strict=False)), self.NAMES[3]))


def tokens(df: DataFrame, c: str, pattern: str = r"\s+", keep: list[str] | None = None) -> DataFrame:
    """FN-51: one row per token of a text column, blank ones left out."""
    return df.select(*(keep or []), F.explode(F.split(F.trim(F.col(c)), pattern)).alias("token")).filter("token <> ''")


def distinct_codes(df: DataFrame, c: str) -> DataFrame:
    """FN-51: distinct codes with the sign apart, and their three-letter prefix."""
    sign = F.when(F.col("token").rlike("^[+-]"), F.substring("token", 1, 1)).otherwise("")
    return tokens(df, c).select(F.regexp_replace("token", "^[+-]", "").alias("code"), sign.alias("sign")).distinct().withColumn("prefix", F.substring("code", 1, 3))


def fixed_width(c: str | Column, width: int) -> Column:
    """FN-52: left-padded with zeros, never cut."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def interactions(visibility: str, is_night: str, severity: str, delay_rate: str, other_severity: str) -> dict[str, Column]:
    """FN-54."""
    return {
        "visibility_at_night": F.col(visibility) * F.col(is_night),
        "severity_by_delay_rate": F.col(severity) * F.col(delay_rate),
        "severity_difference": F.abs(F.col(severity) - F.col(other_severity)),
    }
