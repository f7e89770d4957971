"""Composite pipelines over flights and weather observations (PIP-01 to PIP-05). Only here do the column
names of those tables appear; every step is a general operator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import clock, codes, flags
from tidewater.ml.features import FeatureSpec
from tidewater.ml.runs import RunResult, model_run
from tidewater.operators import clean, joins, sampling, windows
from tidewater.sources import write_table

WEEK_HOURS = 168

#: Columns known only after a flight.
SOURCES = ["ARR_DELAY_NEW", "WEATHER_DELAY", "NAS_DELAY"]
FORBIDDEN = ["FL_DATE", "UTC_FL_DATE", "OP_CARRIER_FL_NUM", "unique_id", "flight_timestamp"]


@dataclass
class Experiment:
    name: str
    features: dict[str, str]
    weather_features: list[str] = field(default_factory=list)
    aggregates: dict[str, str] = field(default_factory=dict)  # weather feature to method
    target: str = "D2_60"
    origin_depth: int = 3
    dest_depth: int = 3
    train_ratio: float = 0.75
    model: str = "randomforest"
    params: dict = field(default_factory=dict)
    grid: dict = field(default_factory=dict)
    folds: int = 3
    seed: int = 42
    reduce: str | None = None


#: Counts of rows that share a key, and the buckets made of them.
COUNTS = {"flights_on_route": "route_id", "carrier_flights": "OP_CARRIER_AIRLINE_ID", "origin_traffic": "ORIGIN_AIRPORT_ID"}
BUCKETS = {"route_popularity": "flights_on_route", "carrier_size": "carrier_flights"}


def preprocess_flights(flights: DataFrame, airports: DataFrame, weather: DataFrame | None = None, wanted: set[str] | None = None) -> DataFrame:
    """PIP-01: enrich with stations and offsets, clean, label flags, arrival, features. Where the columns ``wanted`` are
    named, counts that none of them needs are not made: the planner drops unused columns by itself, but no joins."""
    roles = {"ORIGIN_AIRPORT_ID": "ORIGIN_", "DEST_AIRPORT_ID": "DEST_"}
    dim = airports.withColumn("WBAN", joins.padded_key("WBAN"))
    f = joins.enrich_roles(flights, dim, "AirportID", roles, {"WBAN": "WBAN", "TimeZone": "TIMEZONE"})
    f = clean.first_per_key(f, ["FL_DATE", "OP_CARRIER_AIRLINE_ID", "OP_CARRIER_FL_NUM", "ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID", "CRS_DEP_TIME"])
    f = clean.drop_nulls(f, ["FL_DATE", "ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID", "CRS_DEP_TIME", "CRS_ELAPSED_TIME"])
    f = clean.drop_flagged(f, ["CANCELLED", "DIVERTED"]).drop("CANCELLED", "DIVERTED")
    f = clean.sane_rows(f, ["CRS_DEP_TIME"], ["ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID"], ("ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID"))
    if weather is not None:
        f = joins.having_keys(f, weather, "WBAN", ["ORIGIN_WBAN", "DEST_WBAN"], pad=5)
        f = joins.in_covered_months(f, "FL_DATE", weather, "Date")
    f = clean.with_columns(f, flags.dataset_flags("ARR_DELAY_NEW", "WEATHER_DELAY", "NAS_DELAY"))
    f = clean.with_columns(f, {k.replace("utc_time", "UTC_CRS_DEP_TIME").replace("utc_date", "UTC_FL_DATE"): v for k, v in clock.to_utc("FL_DATE", "CRS_DEP_TIME", "ORIGIN_TIMEZONE").items()})
    f = clean.with_columns(f, {k.replace("arr_", "utc_arr_"): v for k, v in clock.add_duration("UTC_FL_DATE", "UTC_CRS_DEP_TIME", "CRS_ELAPSED_TIME").items() if k in ("arr_time", "arr_date")})
    f = clean.with_columns(f, {k.replace("local_", "local_arr_"): v for k, v in clock.from_utc("utc_arr_date", "utc_arr_time", "DEST_TIMEZONE").items()})
    dep = clock.hhmm_to_minutes("CRS_DEP_TIME")
    f = clean.with_columns(f, clock.calendar_parts("FL_DATE") | clock.clock_parts(dep) | {"utc_dep_hour": clock.hour_of("UTC_CRS_DEP_TIME")}
        | clock.arrival_flags("local_arr_time", "utc_arr_time", "FL_DATE", "local_arr_date", "ORIGIN_TIMEZONE", "DEST_TIMEZONE", "CRS_DEP_TIME", "UTC_CRS_DEP_TIME"))
    f = clean.with_columns(f, flags.period_flags("month", "day_of_month", "day_of_week", "dep_hour") | flags.cyclic("dep_hour_rounded", 24, "dep_hour") | flags.cyclic("week_of_year", 52, "week", start=1)
        | flags.trip_features("CRS_ELAPSED_TIME", "OP_CARRIER_AIRLINE_ID", "OP_CARRIER_FL_NUM", "ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID", "UTC_FL_DATE")
        | flags.place_features("ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID"))
    counts = {n: k for n, k in COUNTS.items() if wanted is None or {n, *(b for b, c in BUCKETS.items() if c == n)} & wanted}
    f = windows.partition_counts(f, counts)
    popular = {b: c for b, c in flags.popularity("flights_on_route", "carrier_flights").items() if BUCKETS[b] in counts}
    return clean.with_columns(f, popular | {"utc_hour_number": _hour_number("UTC_FL_DATE", clock.hour_of("UTC_CRS_DEP_TIME")), "utc_arr_hour_number": _hour_number("utc_arr_date", clock.hour_of("utc_arr_time"))})


def _hour_number(date: str, hour) -> Column:
    return (F.unix_date(F.col(date)).cast("long") * 24 + hour).cast("long")


def preprocess_weather(weather: DataFrame, airports: DataFrame | None = None, flights: DataFrame | None = None) -> DataFrame:
    """PIP-02: one observation per station and hour, code features, deltas, clean numbers. Observation times
    count as UTC."""
    w = weather.withColumns({"WBAN": joins.padded_key("WBAN"), "hour_number": _hour_number("Date", clock.hour_of("Time"))}).filter("hour_number IS NOT NULL")
    if flights is not None:
        w = joins.used_by_roles(w, "WBAN", flights, ["ORIGIN_WBAN", "DEST_WBAN"])
    others = [c for c in w.columns if c not in ("WBAN", "hour_number")]
    w = clean.first_per_key(w, ["WBAN", "hour_number"], order=["Time"]).select("WBAN", "hour_number", *others)
    w = clean.with_columns(w, codes.sky_features("SkyCondition") | codes.visibility_features("Visibility"))
    w = clean.with_columns(w, codes.conditions("visibility_miles", "ceiling", "cloud_risk_score", "visibility_risk_score", "has_obscured") | codes.present_weather("ValueForWindCharacter")
        | {"temp_dewpoint_spread": codes.spread("DryBulbCelsius", "DewPointCelsius")})
    w = clean.with_columns(w, codes.weather_type_features("WeatherType") | codes.icing_features("WeatherType", "DryBulbCelsius", "DewPointCelsius") | codes.pressure_features("PressureTendency", "PressureChange"))
    w = clean.with_columns(w, {"HourlyPrecip": clean.precipitation("HourlyPrecip"), "SeaLevelPressure": clean.marked_missing("SeaLevelPressure")})
    return windows.deltas(w, ["DryBulbCelsius", "RelativeHumidity", "visibility_miles", "StationPressure"], ["WBAN"], ["hour_number"], bucket=F.floor(F.col("hour_number") / WEEK_HOURS))


def data_pipeline(flights: DataFrame, weather: DataFrame, airports: DataFrame, experiments: list[Experiment], out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """PIP-03: both sides preprocessed, pruned to what the experiments use, stored if a folder is given and read from
    there, so that what follows doesn't prepare them again. So are the stations by month that were observed, by which flights
    are kept, and the pairs of stations that flights use, by which observations are: neither side is prepared for the other's sake."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        if not out:
            return df
        write_table(df, f"{out}/{name}")
        return df.sparkSession.read.parquet(f"{out}/{name}")

    seen = kept(weather.select("WBAN", F.trunc("Date", "month").alias("Date")).distinct(), "observed")
    essential = ["unique_id", "ORIGIN_WBAN", "DEST_WBAN", "utc_hour_number", "utc_arr_hour_number", *sorted({e.target for e in experiments}), "month"]
    features = [list(e.features) for e in experiments]
    f = kept(clean.prune(preprocess_flights(flights, airports, seen, set(essential).union(*features)), features, essential), "flights")
    used = kept(f.select("ORIGIN_WBAN", "DEST_WBAN").distinct(), "used")
    w = kept(clean.prune(preprocess_weather(weather, airports, used), [e.weather_features for e in experiments], ["WBAN", "hour_number"]), "weather")
    return f, w


def features_for(flights: DataFrame, weather: DataFrame | None, e: Experiment) -> DataFrame:
    """Look-back join of both sides, flattened, with aggregates over the hours."""
    out, used = flights, []
    for side, key, hour, depth in (("origin_weather_", "ORIGIN_WBAN", "utc_hour_number", e.origin_depth), ("destination_weather_", "DEST_WBAN", "utc_arr_hour_number", e.dest_depth)):
        if weather is None or not e.weather_features or depth < 1:
            continue
        out = joins.look_back(out, weather, key, hour, "WBAN", "hour_number", e.weather_features, depth, prefix=f"_{side}h")
        structs = {f"_{side}h{i}": side for i in range(1, depth + 1)}
        out = clean.any_present(out, list(structs))
        out = clean.flatten_structs(out, structs, e.weather_features, {s: f"_h{i}" for i, s in enumerate(structs, 1)})
        for feature, method in e.aggregates.items():
            hours = [f"{side}{feature}_h{i}" for i in range(1, depth + 1)]
            out = out.withColumn(f"{side}{feature}_{method.capitalize()}", flags.horizontal(hours, method))
            used += hours
    return out.drop(*used)


def feature_pipeline(flights: DataFrame, weather: DataFrame | None, e: Experiment) -> tuple[DataFrame, DataFrame]:
    """PIP-04: label, balance into train and test, attach the weather, guard against leakage."""
    labelled = flights.withColumn("label_is_delayed", flags.flag(F.col(e.target) == 1))
    train, test = sampling.balanced_train_test(labelled, "label_is_delayed", ["unique_id"], e.train_ratio, e.seed)
    guard = lambda d: clean.guard_leakage(features_for(d, weather, e), "label_is_delayed", SOURCES)
    return guard(train), guard(test)


def ml_pipeline(train: DataFrame, test: DataFrame, e: Experiment, folder: str, fast: bool = False) -> RunResult:
    """PIP-05: a whole model run of an experiment, each step stored under ``folder`` and read back where it is there
    already; see ``runs.model_run``."""
    spec = FeatureSpec(features=e.features | {f: "None" for f in e.weather_features}, target="label_is_delayed", reduce=e.reduce)
    return model_run(train, test, folder, spec, ["unique_id"], e.model, e.params, e.grid, e.folds, seed=e.seed, fast=fast)
