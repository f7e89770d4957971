"""Queries of clock, calendar, flag and code functions over events and orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.functions import clock, codes, flags
from tidewater.operators import clean
from tidewater.plans.registry import query, rounded, table

M = "(hour(ts) * 60 + minute(ts))"
OFF = "(CAST(user_id % 21 AS INT) - 10)"


def clocked(spark, d):
    """Events with a local date, HHmm, an offset of -10 to 10 hours and a duration in minutes."""
    e = table(spark, d, "events")
    m = F.hour("ts") * 60 + F.minute("ts")
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.to_date("ts").alias("date"), (F.hour("ts") * 100 + F.minute("ts")).alias("hhmm"), m.alias("minutes"),
        (F.col("user_id") % 21 - 10).cast("int").alias("offset"), (F.col("event_id") % 900).cast("double").alias("duration"))


def _hhmm(m: str) -> str:
    return f"printf('%02d%02d', CAST((({m}) % 1440 + 1440) % 1440 // 60 AS INT), CAST((({m}) % 1440 + 1440) % 1440 % 60 AS INT))"


def _date(m: str) -> str:
    return f"CAST(CAST(ts AS DATE) + CAST(floor(({m}) / 1440.0::DOUBLE) AS INT) AS VARCHAR)"


@query(f"SELECT event_id, {_hhmm(f'{M} - {OFF} * 60')} AS utc_time, {_date(f'{M} - {OFF} * 60')} AS utc_date, {_hhmm(f'{M} + {OFF} * 60')} AS local_time, {_date(f'{M} + {OFF} * 60')} AS local_date FROM events")
def utc_and_local(spark, d):
    """FN-01, FN-03, FN-52."""
    made = clock.to_utc("date", "hhmm", "offset") | clock.from_utc("date", "hhmm", "offset")
    return clean.with_columns(clocked(spark, d), made).select("event_id", *[F.col(c).cast("string").alias(c) for c in made])


D = f"({M} + CAST(event_id % 900 AS INT))"


@query(f"""SELECT event_id, {_hhmm(D)} AS arr_time, {_date(D)} AS arr_date, CAST({D} % 1440 AS INT) AS arr_minutes, CAST({D} % 1440 // 60 AS INT) AS arr_hour, CAST({D} % 60 AS INT) AS arr_minute, round({D} % 1440 / 60.0::DOUBLE, 6) AS arr_hour_decimal,
  CAST(({D} % 1440 + 30) // 60 % 24 AS INT) AS arr_hour_rounded, CAST({D} >= 1440 AS INT) AS arr_crosses_midnight, CAST({D} // 1440 AS INT) AS arr_days_span FROM events""")
def arrivals(spark, d):
    """FN-02, FN-07."""
    made = clock.add_duration("date", "hhmm", "duration")
    return clean.with_columns(clocked(spark, d), made | {"arr_hour_decimal": rounded(made["arr_hour_decimal"]), "arr_date": made["arr_date"].cast("string")}).select("event_id", *made)


@query(f"""SELECT event_id, CAST({D} % 1440 // 60 AS INT) AS arrival_hour, printf('%02d00', CAST({D} % 1440 // 60 AS INT)) AS arrival_hour_floor,
  ['Late_Night','Early_Morning','Morning','Late_Morning','Early_Afternoon','Late_Afternoon','Evening','Night'][CAST({D} % 1440 // 180 AS INT) + 1] AS arrival_period, CAST({D} % 1440 < {M} AS INT) AS crosses_midnight_local,
  CAST({D} // 1440 AS INT) AS arrival_day_span, 3 - {OFF} AS zone_difference, CAST(3 > {OFF} AS INT) AS is_eastward, CAST(3 < {OFF} AS INT) AS is_westward FROM events""")
def arrival_flags(spark, d):
    """FN-04: every place of arrival lies three hours east."""
    x = clean.with_columns(clocked(spark, d).withColumn("to_offset", F.lit(3)), clock.add_duration("date", "hhmm", "duration"))
    made = clock.arrival_flags("arr_time", "arr_time", "date", "arr_date", "offset", "to_offset", "hhmm", "hhmm")
    return clean.with_columns(x, made).select("event_id", *[c for c in made if "utc" not in c])


@query(f"""SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter, concat('Q', quarter(ts)) AS quarter_name, CAST(day(ts) AS INT) AS day_of_month, CAST(dayofweek(ts) + 1 AS INT) AS day_of_week,
  CAST(dayofyear(ts) AS INT) AS day_of_year, CAST(week(ts) AS INT) AS week_of_year, CAST(hour(ts) AS INT) AS dep_hour, CAST(minute(ts) AS INT) AS dep_minute, CAST({M} // 360 AS INT) AS dep_quarter_day,
  ['Night','Morning','Afternoon','Evening'][CAST({M} // 360 AS INT) + 1] AS dep_quarter_name, CAST({M} AS INT) AS dep_minutes, CAST(({M} + 30) // 60 % 24 AS INT) AS dep_hour_rounded, strftime(ts, '%Y-%m') AS month_key FROM events""")
def calendar_and_clock(spark, d):
    """FN-05, FN-06, FN-08, FN-12."""
    made = clock.calendar_parts("ts") | clock.clock_parts("minutes")
    kept = [c for c in made if c not in ("dep_hour_decimal", "dep_period")]
    return clean.with_columns(clocked(spark, d), made | {"month_key": clock.month_key("ts")}).select("event_id", *kept, "month_key")


@query("""SELECT event_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start, CAST(CAST(ts AS DATE) AS VARCHAR) AS parsed, CAST(year(ts) AS DOUBLE) AS ts_year, CAST(month(ts) AS DOUBLE) AS ts_month, CAST(day(ts) AS DOUBLE) AS ts_day,
  CAST(dayofweek(ts) + 1 AS DOUBLE) AS ts_weekday, CAST(floor(epoch(ts)) AS DOUBLE) AS ts_unix, CAST(hour(ts) AS DOUBLE) AS ts_hour, CAST(minute(ts) AS DOUBLE) AS ts_minute FROM events""")
def date_expansion(spark, d):
    """FN-09, FN-10, FN-11: the date comes as text in one of three formats."""
    text = F.expr("CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, 'yyyyMMdd') ELSE date_format(ts, 'MM/dd/yyyy') END")
    e = clocked(spark, d).withColumn("text", text)
    made = clock.date_features("ts", timestamp=True)
    return clean.with_columns(e, made | {"hour_start": F.unix_timestamp(clock.date_and_hour("date", F.hour("ts"))), "parsed": clock.parse_date("text").cast("string")}).select("event_id", "hour_start", "parsed", *made)


PI = math.pi


@query(f"""SELECT event_id, round(sin(hour(ts) * {2 * PI / 24}), 6) AS hour_sin, round(cos(hour(ts) * {2 * PI / 24}), 6) AS hour_cos, round(sin((week(ts) - 1) * {2 * PI / 52}), 6) AS week_sin, round(cos((week(ts) - 1) * {2 * PI / 52}), 6) AS week_cos FROM events""")
def cyclic_encoding(spark, d):
    """FN-20, FN-21."""
    made = flags.cyclic(F.hour("ts"), 24, "hour") | flags.cyclic(F.weekofyear("ts"), 52, "week", start=1)
    return table(spark, d, "events").select("event_id", *[F.round(v, 6).alias(k) for k, v in made.items()])


@query("""WITH x AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) + 1 AS w, CAST(o_orderkey % 24 AS INT) AS h FROM orders)
SELECT m AS month, CAST(sum((w IN (1, 7))::INT) AS BIGINT) AS is_weekend, CAST(sum((w = 6)::INT) AS BIGINT) AS is_friday, CAST(sum((m IN (12, 1, 2))::INT) AS BIGINT) AS is_winter,
  CAST(sum((m IN (11, 12, 1, 7) OR (m = 3 AND d BETWEEN 15 AND 31))::INT) AS BIGINT) AS is_holiday_season, CAST(sum((h BETWEEN 6 AND 9)::INT) AS BIGINT) AS is_morning_rush, CAST(sum((h >= 22 OR h <= 5)::INT) AS BIGINT) AS is_night,
  CAST(sum((d >= 26)::INT) AS BIGINT) AS is_month_end, CAST(sum(((w = 6 AND h <= 12) OR (w = 1 AND h >= 18))::INT) AS BIGINT) AS is_extended_weekend FROM x GROUP BY 1""")
def period_flags(spark, d):
    """FN-22, as counts by month."""
    o = table(spark, d, "orders").select(F.month("o_orderdate").cast("long").alias("month"), F.dayofmonth("o_orderdate").alias("d"), F.dayofweek("o_orderdate").alias("w"), (F.col("o_orderkey") % 24).cast("int").alias("h"))
    made = flags.period_flags("month", "d", "w", "h")
    kept = ["is_weekend", "is_friday", "is_winter", "is_holiday_season", "is_morning_rush", "is_night", "is_month_end", "is_extended_weekend"]
    return clean.with_columns(o, made).groupBy("month").agg(*[F.sum(c).alias(c) for c in kept])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('_', least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey)) AS route_id, CASE WHEN l_quantity <= 90 THEN 'short' ELSE 'medium' END AS distance_category,
  round(least(l_quantity / 600, 1), 6) AS distance_score, CAST(l_suppkey IN (7, 11, 13) AS INT) AS origin_is_hub, (l_partkey % 100) / 100.0::DOUBLE AS dest_complexity, abs(l_suppkey % 10 - l_partkey % 10) AS zone_proxy,
  CAST(l_partkey > l_suppkey AS INT) AS is_eastbound, CAST(l_suppkey IN (7, 11, 13) AND l_partkey IN (7, 11, 13) AS INT) AS is_hub_to_hub FROM lineitem""")
def trip_and_place_features(spark, d):
    """FN-23, FN-24: suppliers and parts as the ends of a route."""
    li = table(spark, d, "lineitem")
    made = flags.trip_features("l_quantity", "l_suppkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate") | flags.place_features("l_suppkey", "l_partkey", [7, 11, 13])
    x = clean.with_columns(li, made | {"distance_score": rounded(made["distance_score"])})
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "route_id", "distance_category", "distance_score", "origin_is_hub", "dest_complexity", "zone_proxy", "is_eastbound", "is_hub_to_hub")


HOURS = [f"v{i}" for i in range(1, 7)]


def _lags_sql() -> str:
    lags = ", ".join(f"coalesce(lag(value, {i}) OVER w, 0) AS v{i}" for i in range(1, 7))
    return f"x AS (SELECT event_id, {lags} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"""WITH {_lags_sql()}, y AS (SELECT *, (v1+v2+v3+v4+v5+v6) / 6.0::DOUBLE AS mean, (v1 - v6) / 5.0::DOUBLE AS slope FROM x)
SELECT event_id, round(v1+v2+v3+v4+v5+v6, 4) AS h_sum, round(mean, 4) AS h_avg, greatest(v1,v2,v3,v4,v5,v6) AS h_max, least(v1,v2,v3,v4,v5,v6) AS h_min, round(sqrt(({" + ".join(f"pow(v{i} - mean, 2)" for i in range(1, 7))}) / 6), 4) AS h_std,
  round(greatest(v1,v2,v3,v4,v5,v6) - least(v1,v2,v3,v4,v5,v6), 4) AS h_range, round(slope, 4) AS h_slope, CASE WHEN slope < -0.1 THEN -1 WHEN slope > 0.1 THEN 1 ELSE 0 END AS v_trend_direction,
  round((v1 - v3) / 2.0::DOUBLE - (v4 - v6) / 2.0::DOUBLE, 4) AS v_trend_acceleration FROM y""")
def horizontal_aggregates(spark, d):
    """FN-26, FN-27: over the six values before each event."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumns({f"v{i}": F.lag("value", i).over(w) for i in range(1, 7)})
    made = {f"h_{m}": flags.horizontal(HOURS, m) for m in ("sum", "avg", "max", "min", "std", "range", "slope")}
    trend = flags.trends(HOURS, "v")
    return e.select("event_id", *[F.round(v, 4).alias(k) for k, v in made.items()], trend["v_trend_direction"].alias("v_trend_direction"), F.round(trend["v_trend_acceleration"], 4).alias("v_trend_acceleration"))


@query(f"""WITH {_lags_sql()} SELECT CAST(sum((coalesce(v1, 10) - coalesce(v3, 10) < -5)::INT) AS BIGINT) AS visibility_deteriorating_fast,
  CAST(sum((v1 - v3 < -2 AND v4 - v6 > 10 AND v1 < 5)::INT) AS BIGINT) AS icing_conditions_developing FROM x""")
def critical_trends(spark, d):
    """FN-28, as counts."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumns({f"v{i}": F.coalesce(F.lag("value", i).over(w), F.lit(0.0)) for i in range(1, 7)})
    made = flags.critical_trends(["v1", "v3"], ["v1", "v3"], ["v4", "v6"])
    return clean.with_columns(e, made).agg(*[F.sum(c).alias(c) for c in made])


SKY = "CASE event_id % 6 WHEN 1 THEN 'CLR' WHEN 2 THEN 'FEW025 SCT040 BKN100' WHEN 3 THEN 'OVC005' WHEN 4 THEN 'VV002' WHEN 5 THEN 'BKN' END"
WX = "CASE event_id % 7 WHEN 1 THEN '-RA' WHEN 2 THEN '+TSRA' WHEN 3 THEN 'FZRA' WHEN 4 THEN '-SN BR' WHEN 5 THEN 'FG' WHEN 6 THEN 'GR' END"


def coded(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", "user_id", "value", "ts", F.expr(SKY).alias("sky"), F.expr(WX).alias("weather"), F.when(F.col("event_id") % 11 == 0, "M").otherwise((F.col("value") / 4).cast("string")).alias("visibility"),
        (F.col("value") - 20).alias("temperature"), (F.col("value") - 22).alias("dew_point"), (F.col("event_id") % 10).cast("string").alias("tendency"), (F.col("value") - 12).alias("change"), (F.col("event_id") % 100).cast("string").alias("code"))


SKY_SQL = f"""s AS (SELECT *, {SKY} AS sky, {WX} AS wx, CASE WHEN event_id % 11 = 0 THEN 10.0 ELSE least(value / 4, 10) END AS v, value - 20 AS t FROM events),
k AS (SELECT *, CASE event_id % 6 WHEN 2 THEN 10000 WHEN 3 THEN 500 WHEN 4 THEN 0 ELSE 99999 END AS ceiling, CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 3.0 WHEN 3 THEN 4.0 WHEN 4 THEN 5.0 ELSE 3.0 END::DOUBLE AS cloud_risk_score,
  CASE WHEN v < 0.5 THEN 5.0 WHEN v < 1 THEN 4.0 WHEN v < 3 THEN 3.0 WHEN v < 5 THEN 2.0 WHEN v < 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS vr FROM s)"""


@query(f"""WITH {SKY_SQL} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'CLR' WHEN 2 THEN 'BKN' WHEN 3 THEN 'OVC' WHEN 4 THEN 'VV' ELSE 'BKN' END AS most_critical_sky,
  CASE event_id % 6 WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE 1 END AS num_cloud_layers, cloud_risk_score, CAST(event_id % 6 IN (2, 5) AS INT) AS has_broken, CAST(event_id % 6 = 1 AS INT) AS is_clear,
  CASE event_id % 6 WHEN 2 THEN 2500 WHEN 3 THEN 500 ELSE 99999 END AS lowest_cloud_height, ceiling, CAST(ceiling < 1000 AS INT) AS has_low_ceiling FROM k""")
def sky_conditions(spark, d):
    """FN-40, FN-41."""
    made = codes.sky_features("sky")
    return clean.with_columns(coded(spark, d), made).select("event_id", *[c for c in made if c not in ("has_overcast", "has_obscured")])


@query(f"""WITH {SKY_SQL} SELECT event_id, round(v, 6) AS visibility_miles, CASE WHEN v < 0.5 THEN 'LIFR' WHEN v < 1 THEN 'IFR_LOW' WHEN v < 3 THEN 'IFR' WHEN v < 5 THEN 'MVFR' WHEN v < 10 THEN 'VFR' ELSE 'VFR_HIGH' END AS visibility_category, vr AS visibility_risk_score,
  round(least(cloud_risk_score * 0.4 + vr * 0.6 + CASE WHEN ceiling < 500 THEN 2 WHEN ceiling < 1000 THEN 1 ELSE 0 END + CASE WHEN v < 0.5 THEN 2 WHEN v < 1 THEN 1 ELSE 0 END, 10), 6)::DOUBLE AS weather_severity_index,
  CAST(v >= 5 AND ceiling >= 3000 AS INT) AS is_vfr, CAST(v < 3 OR ceiling < 1000 AS INT) AS is_ifr, CASE WHEN event_id % 6 = 4 OR v < 0.25 OR ceiling < 100 THEN 4 WHEN v < 1 OR ceiling < 500 THEN 3 WHEN v < 3 OR ceiling < 1000 THEN 2 WHEN v < 5 OR ceiling < 3000 THEN 1 ELSE 0 END AS operations_risk_level,
  CASE WHEN v < 1 OR ceiling < 500 THEN 'LIFR' WHEN v < 3 OR ceiling < 1000 THEN 'IFR' WHEN v <= 5 OR ceiling <= 3000 THEN 'MVFR' ELSE 'VFR' END AS flight_category FROM k""")
def flight_conditions(spark, d):
    """FN-44, FN-45, FN-46, FN-53."""
    x = clean.with_columns(coded(spark, d), codes.sky_features("sky") | codes.visibility_features("visibility"))
    x = clean.with_columns(x, codes.conditions("visibility_miles", "ceiling", "cloud_risk_score", "visibility_risk_score", "has_obscured"))
    return x.select("event_id", rounded("visibility_miles").alias("visibility_miles"), "visibility_category", "visibility_risk_score", rounded("weather_severity_index").alias("weather_severity_index"), "is_vfr", "is_ifr", "operations_risk_level", "flight_category")


@query(f"""WITH {SKY_SQL}, r AS (SELECT *, event_id % 7 AS w FROM k) SELECT event_id, CASE w WHEN 2 THEN 'heavy' WHEN 1 THEN 'light' WHEN 4 THEN 'light' ELSE 'moderate' END AS weather_intensity, CAST(w = 2 AS INT) AS has_thunderstorm, CAST(w IN (1, 2, 3, 4, 6) AS INT) AS has_precipitation,
  CAST(w IN (4, 5) AS INT) AS has_fog_mist, regexp_replace(wx, '^[+-]', '') AS extracted_codes, CASE WHEN w IN (2, 3) THEN 3 WHEN w IN (1, 4, 5, 6) THEN 1 ELSE 0 END AS hazard_level,
  CASE WHEN w = 3 THEN 1 WHEN t BETWEEN -15 AND 2 THEN 1 ELSE 0 END AS icing_risk_flag, CASE WHEN w = 3 THEN 3 WHEN t BETWEEN -10 AND 0 AND w IN (1, 2, 4, 5) THEN 2 WHEN t BETWEEN -15 AND 2 THEN 1 ELSE 0 END AS icing_risk_level FROM r""")
def weather_codes(spark, d):
    """FN-42, FN-43, FN-48: the dew point is always 2 below the temperature."""
    x = clean.with_columns(coded(spark, d).withColumn("dew_point", F.col("temperature") - 1.9), codes.weather_type_features("weather") | codes.icing_features("weather", "temperature", "dew_point"))
    return x.select("event_id", "weather_intensity", "has_thunderstorm", "has_precipitation", "has_fog_mist", "extracted_codes", "hazard_level", "icing_risk_flag", "icing_risk_level")


WEATHERS = ["+TSRAGR", "-SHRA BR", "FZFG", "RASN", "RA", "", "-FZRAPL HZ", "BLSNX", "vcts +ra", "  ", "PRFG12", "TSRA TSRA SQ", "A", "-", "GRRAFC PY"]
LISTED = ", ".join(f"'{x}'" for x in codes.COMPOSITES)


@query(f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 16 < 15 THEN {WEATHERS}[event_id % 16 + 1] END AS w FROM events), g AS (SELECT event_id, w, unnest(string_split_regex(trim(upper(regexp_replace(coalesce(w, ''), '^[+-]', ''))), '\\s+')) AS g FROM x),
c AS (SELECT event_id, unnest(list_concat(list_filter(regexp_extract_all(g, '..'), lambda p: regexp_matches(p, '^[A-Z]{{2}}$')), list_filter([substr(g, 1, 4)], lambda p: p IN ({LISTED})))) AS code FROM g),
s AS (SELECT event_id, list_sort(list(DISTINCT code)) AS found FROM c GROUP BY 1)
SELECT x.event_id, coalesce(array_to_string(found, ','), '') AS parsed_codes, CASE WHEN trim(w) LIKE '+%' THEN 'HEAVY' WHEN trim(w) LIKE '-%' THEN 'LIGHT' ELSE 'MODERATE' END AS parsed_intensity,
  CAST(coalesce(list_has_any(found, ['TS']), false) AS INT) AS parsed_thunderstorm, CAST(coalesce(list_has_any(found, ['FZ']), false) AS INT) AS parsed_freezing,
  CAST(coalesce(list_has_any(found, ['RA', 'DZ', 'SN', 'GR', 'GS', 'PL', 'SG', 'IC', 'UP']), false) AS INT) AS parsed_precipitation, CAST(coalesce(list_has_any(found, ['BR', 'FG', 'FU', 'HZ', 'DU', 'SA', 'VA', 'PY']), false) AS INT) AS parsed_obscuration,
  CAST(coalesce(list_has_any(found, ['DS', 'SS', 'FC', 'SQ', 'PO']), false) AS INT) AS parsed_hazard FROM x LEFT JOIN s ON s.event_id = x.event_id""")
def composite_codes(spark, d):
    """UDF-03: glued weather codes taken apart, and the flags that follow."""
    e = table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, WEATHERS)), F.pmod("event_id", F.lit(16)).cast("int")).alias("weather"))
    made = codes.weather_conditions("weather")
    return clean.with_columns(e, made).select("event_id", F.array_join("parsed_codes", ",").alias("parsed_codes"), *list(made)[1:])


def _case(tbl: dict) -> str:
    return "CASE " + " ".join(f"WHEN event_id % 100 IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in tbl.items()) + " ELSE '{}' END"


@query(f"""SELECT event_id, {_case(codes.WEATHER_TYPES).format('Clear_or_Other')} AS weather_type, {_case(codes.WEATHER_INTENSITIES).format('Not_Applicable')} AS weather_intensity_name,
  CASE WHEN event_id % 10 IN (1, 2, 3) THEN 1 WHEN event_id % 10 IN (4, 5, 6, 7, 8) THEN -1 WHEN event_id % 10 = 0 THEN 0 END AS pressure_trend_sign, CAST(abs(value - 12) > 20 AS INT) AS pressure_variation_risk, CAST(value - 12 <= -2 AS INT) AS pressure_dropping_fast,
  CASE WHEN abs(value - 12) <= 9 THEN 'stable' WHEN abs(value - 12) <= 20 THEN 'transition' ELSE 'disturbed' END AS pressure_bucket FROM events""")
def lookups_and_pressure(spark, d):
    """FN-47, FN-49."""
    made = codes.present_weather("code") | codes.pressure_features("tendency", "change")
    return clean.with_columns(coded(spark, d), made).select("event_id", *[c for c in made if c not in ("pressure_change", "pressure_change_abs")])


@query("""WITH q AS (SELECT quantile_disc(l_extendedprice, 0.25) AS a, quantile_disc(l_extendedprice, 0.5) AS b, quantile_disc(l_extendedprice, 0.75) AS c FROM lineitem WHERE l_returnflag = 'R')
SELECT bin, count(*) AS n FROM (SELECT CASE WHEN l_extendedprice <= a THEN 'low' WHEN l_extendedprice <= b THEN 'moderate' WHEN l_extendedprice <= c THEN 'high' ELSE 'very_high' END AS bin FROM lineitem, q) GROUP BY 1""")
def quantile_bins(spark, d):
    """FN-50: cut points from one part of the items, bins for all."""
    li = table(spark, d, "lineitem")
    bins = codes.QuantileBins(None).fit(li.filter("l_returnflag = 'R'"), "l_extendedprice")
    return li.groupBy(bins.column("l_extendedprice").alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT regexp_replace(token, '^[+-]', '') AS code, CASE WHEN regexp_matches(token, '^[+-]') THEN substr(token, 1, 1) ELSE '' END AS sign, substr(regexp_replace(token, '^[+-]', ''), 1, 3) AS prefix
FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token <> ''""")
def name_tokens(spark, d):
    """FN-51 over part names."""
    return codes.distinct_codes(table(spark, d, "part"), "p_name")


@query("SELECT event_id, value * CAST(hour(ts) >= 22 OR hour(ts) <= 5 AS INT) AS visibility_at_night, value * 2 AS severity_by_delay_rate, abs(value - user_id) AS severity_difference FROM events")
def interaction_columns(spark, d):
    """FN-54."""
    e = table(spark, d, "events").withColumns({"night": flags.flag((F.hour("ts") >= 22) | (F.hour("ts") <= 5)), "rate": F.lit(2.0)})
    made = codes.interactions("value", "night", "value", "rate", "user_id")
    return clean.with_columns(e, made).select("event_id", *made)
