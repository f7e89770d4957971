"""Queries of look-back, as-of, interval and window operators over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.flags import at_least
from tidewater.operators import joins, windows
from tidewater.plans.registry import query, rounded, table

HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"
E = f"e AS (SELECT *, {HOUR} AS h, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"
FIRST = "f AS (SELECT user_id, h, min({'event_id': event_id, 'value': value}) AS o FROM e GROUP BY 1, 2)"
DEPTH = 6


def events(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_timestamp("ts"))
    return e.withColumn("h", F.floor(F.col("s") / 3600))


def _look_back_sql() -> str:
    picks = ", ".join(f"f{i}.o.event_id AS h{i}_event_id, f{i}.o.value AS h{i}_value" for i in range(1, DEPTH + 1))
    some = " ".join(f"LEFT JOIN f f{i} ON f{i}.user_id = e.user_id AND f{i}.h = e.h - {i}" for i in range(1, DEPTH + 1))
    return f"""WITH {E}, {FIRST}, days AS (SELECT DISTINCT user_id, d FROM (SELECT user_id, CAST(floor(h / 24) AS BIGINT) AS d FROM e UNION ALL SELECT user_id, CAST(floor(h / 24) AS BIGINT) + 1 FROM e))
SELECT e.event_id, {picks} FROM e {some} WHERE e.event_type = 'purchase' AND EXISTS (SELECT 1 FROM days WHERE days.user_id = e.user_id AND days.d = CAST(floor(e.h / 24) AS BIGINT))"""


@query(_look_back_sql())
def look_back_hours(spark, d):
    """JOIN-05, JOIN-06, AGG-01, PRJ-08: each purchase with the user's first event of each of the six hours
    before it."""
    e = events(spark, d)
    facts = e.filter("event_type = 'purchase'").select("event_id", "user_id", "h")
    out = joins.look_back(facts, e.select("user_id", "h", "event_id", "value"), "user_id", "h", "user_id", "h", ["event_id", "value"], DEPTH)
    flat = [F.col(f"h{i}.{f}").alias(f"h{i}_{f}") for i in range(1, DEPTH + 1) for f in ("event_id", "value")]
    return out.select("event_id", *flat)


@query(f"""WITH {E}, m AS (SELECT a.event_id, count(*) AS n, CAST(min(a.h - b.h) AS INT) AS nearest, round(sum(b.value), 4) AS total FROM e a JOIN e b ON a.user_id = b.user_id AND b.h BETWEEN a.h - 12 AND a.h - 1
  WHERE a.event_type = 'error' GROUP BY 1) SELECT a.event_id, coalesce(m.n, 0) AS n, m.nearest, m.total FROM e a LEFT JOIN m USING (event_id) WHERE a.event_type = 'error'""")
def look_back_offsets(spark, d):
    """JOIN-14: the fan-out plan, twelve hours."""
    e = events(spark, d)
    facts = e.filter("event_type = 'error'").select("event_id", "user_id", "h")
    out = joins.look_back_by_offsets(facts, e.select("user_id", "h", "value"), "event_id", "user_id", "h", "user_id", "h", ["value"], 12)
    total = F.aggregate(F.transform("observations", lambda o: o["value"]), F.lit(0.0), lambda a, v: a + v)
    return out.select("event_id", F.coalesce(F.size("observations"), F.lit(0)).cast("long").alias("n"), F.col("observations")[0]["hours_before"].alias("nearest"), F.round(total, 4).alias("total"))


OBS = "event_type = 'signup'"


@query(f"""WITH {E}, o AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, hour(ts) AS hh FROM e WHERE {OBS}), c AS (SELECT e.event_id,
  CASE WHEN o.hh IS NOT NULL THEN 'matched' WHEN od.d IS NOT NULL THEN 'missing_hour' WHEN ok.user_id IS NOT NULL THEN 'missing_date' ELSE 'missing_station' END AS reason
  FROM e LEFT JOIN (SELECT DISTINCT user_id FROM o) ok ON ok.user_id = e.user_id LEFT JOIN (SELECT DISTINCT user_id, d FROM o) od ON od.user_id = e.user_id AND od.d = CAST(e.ts AS DATE)
  LEFT JOIN o ON o.user_id = e.user_id AND o.d = CAST(e.ts AS DATE) AND o.hh = hour(e.ts) WHERE e.event_type = 'purchase')
SELECT reason, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM c GROUP BY 1""")
def join_coverage(spark, d):
    """JOIN-08: purchases against the signups."""
    e = events(spark, d)
    return joins.coverage_report(joins.coverage(e.filter("event_type = 'purchase'"), e.filter(OBS), "user_id", "ts", "user_id", "ts"))


@query(f"""WITH {E}, g AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM e), x AS (SELECT g.user_id, g.day, r.hour, abs(CAST(epoch(g.day) AS BIGINT) + r.hour * 3600 - e.s) AS distance, e.event_id,
  row_number() OVER (PARTITION BY g.user_id, g.day, r.hour ORDER BY abs(CAST(epoch(g.day) AS BIGINT) + r.hour * 3600 - e.s), e.event_id) AS rn
  FROM g CROSS JOIN (SELECT unnest(range(24)) AS hour) r JOIN e ON e.user_id = g.user_id AND CAST(e.ts AS DATE) = g.day)
SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(hour AS INT) AS hour, CAST(distance AS BIGINT) AS distance, event_id FROM x WHERE rn = 1""")
def nearest_to_hours(spark, d):
    """JOIN-09."""
    return joins.nearest_to_hours(events(spark, d), "user_id", "ts", "event_id").withColumn("day", F.col("day").cast("string"))


TRAILING = """FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 21600 PRECEDING AND 7200 PRECEDING)"""


@query(f"WITH {E} SELECT event_id, CAST(count(value) OVER w AS BIGINT) AS range_n, round(avg(value) OVER w, 6) AS range_avg {TRAILING}")
def range_self_join(spark, d):
    """JOIN-10."""
    return joins.range_statistics(events(spark, d).select("event_id", "user_id", "s", "value"), "user_id", "s", "value", "event_id", 7200, 21600).select("event_id", "range_n", rounded("range_avg").alias("range_avg"))


@query(f"""WITH {E} SELECT event_id, CAST(count(value) OVER w AS BIGINT) AS trailing_count, round(coalesce(avg(value) OVER w, 0), 6) AS trailing_avg, coalesce(max(value) OVER w, 0) AS trailing_max,
  coalesce(min(value) OVER w, 0) AS trailing_min, round(stddev_samp(value) OVER w, 4) AS trailing_std, round(coalesce(avg(CASE WHEN value >= 10 THEN 1.0::DOUBLE ELSE 0 END) OVER w, 0), 6) AS trailing_share_1,
  round(coalesce(avg(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0 END) OVER w, 0), 6) AS trailing_share_2 {TRAILING}""")
def trailing_statistics(spark, d):
    """WIN-03: six to two hours back."""
    x = windows.trailing_statistics(events(spark, d), "user_id", "s", "value", 7200, 21600, [10.0, 50.0])
    return x.select("event_id", "trailing_count", "trailing_max", "trailing_min", *[rounded(c).alias(c) for c in ("trailing_avg", "trailing_share_1", "trailing_share_2")], rounded("trailing_std", 4).alias("trailing_std"))


@query(f"""WITH {E}, b AS (SELECT user_id, h AS bucket, count(value) AS n, sum(value) AS t, max(value) AS mx, min(value) AS mn FROM e GROUP BY 1, 2),
r AS (SELECT user_id, bucket, round(sum(t) OVER w / sum(n) OVER w, 6) AS rolled_avg, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS rolled_count, max(mx) OVER w AS rolled_max, min(mn) OVER w AS rolled_min
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN 6 PRECEDING AND 2 PRECEDING))
SELECT e.event_id, r.rolled_avg, r.rolled_count, r.rolled_max, r.rolled_min FROM e LEFT JOIN r ON r.user_id = e.user_id AND r.bucket = e.h""")
def rolled_hours(spark, d):
    """AGG-02, WIN-04, JOIN-13."""
    e = events(spark, d)
    rolled = windows.rolled_buckets(windows.hour_statistics(e, "user_id", "s", "value", [10.0]), "user_id", 6, 2)
    out = joins.join_buckets(e.withColumnRenamed("h", "bucket"), rolled, "user_id", "bucket")
    return out.select("event_id", rounded("rolled_avg").alias("rolled_avg"), "rolled_count", "rolled_max", "rolled_min")


@query(f"""WITH {E} SELECT user_id, bucket, n AS hour_count, round(a, 6) AS hour_avg, round(sd, 4) AS hour_std, mx AS hour_max, mn AS hour_min, round(sh, 6) AS hour_share_1 FROM (SELECT user_id, h AS bucket, count(value) AS n, avg(value) AS a,
  stddev_samp(value) AS sd, max(value) AS mx, min(value) AS mn, avg(CASE WHEN value >= 10 THEN 1.0::DOUBLE ELSE 0 END) AS sh FROM e GROUP BY 1, 2)""")
def hour_statistics(spark, d):
    """AGG-02."""
    x = windows.hour_statistics(events(spark, d), "user_id", "s", "value", [10.0])
    return x.select("user_id", "bucket", "hour_count", rounded("hour_avg").alias("hour_avg"), rounded("hour_std", 4).alias("hour_std"), "hour_max", "hour_min", rounded("hour_share_1").alias("hour_share_1"))


@query(f"""WITH {E} SELECT event_id, CAST(len(l) AS INT) AS n, list_min(l) AS first_hour, list_max(l) AS last_hour FROM (SELECT a.event_id, list(b.h) FILTER (b.h IS NOT NULL) AS l FROM e a
  LEFT JOIN e b ON b.user_id = a.user_id AND b.event_type = 'view' AND b.h BETWEEN a.h - 12 AND a.h WHERE a.event_type = 'purchase' GROUP BY 1) WHERE l IS NOT NULL""")
def day_lists(spark, d):
    """JOIN-11: purchases with any view in the twelve hours before or the hour itself."""
    e = events(spark, d)
    x = joins.day_lists(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "user_id", "ts", ["value"])
    hours = F.transform("observations", lambda o: o["hour"])
    return x.filter(F.size("observations") > 0).select("event_id", F.size("observations").alias("n"), F.array_min(hours).alias("first_hour"), F.array_max(hours).alias("last_hour"))


@query(f"WITH {E} SELECT a.event_id, b.event_id AS purchase_id, b.value AS purchase_value FROM (SELECT * FROM e WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of_purchase(spark, d):
    """JOIN-15: the last purchase before each error."""
    e = events(spark, d)
    x = joins.as_of(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "user_id", "ts", ["event_id", "value"])
    return x.select("event_id", F.col("as_of.event_id").alias("purchase_id"), F.col("as_of.value").alias("purchase_value"))


@query(f"""WITH {E} SELECT a.event_id, n.near_distance, n.near_id FROM (SELECT * FROM e WHERE event_type = 'purchase') a LEFT JOIN LATERAL (SELECT abs(a.s - b.s) AS near_distance, b.event_id AS near_id FROM e b
  WHERE b.user_id = a.user_id AND b.event_type = 'view' AND abs(a.s - b.s) <= 1800 ORDER BY 1, 2 LIMIT 1) n ON true""")
def nearest_within_interval(spark, d):
    """JOIN-16: the nearest view within half an hour of each purchase."""
    e = events(spark, d)
    return joins.within_interval(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'"), "user_id", "ts", "event_id", "user_id", "ts", "event_id", 30).select("event_id", "near_distance", "near_id")


@query(f"""WITH {E}, o AS (SELECT user_id, s AS t, avg(value) AS v FROM e GROUP BY 1, 2), p AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t)),
x AS (SELECT *, unnest(range(CAST(ceil(t / 3600) AS BIGINT), CASE WHEN t2 IS NULL THEN CAST(floor(t / 3600) AS BIGINT) + 1 ELSE CAST(ceil(t2 / 3600) AS BIGINT) END)) AS hour FROM p)
SELECT user_id, hour, round(CASE WHEN hour * 3600 = t THEN v ELSE v + (v2 - v) * (hour * 3600 - t) / (t2 - t) END, 6) AS value FROM x""")
def interpolated_hours(spark, d):
    """JOIN-17."""
    return joins.interpolate_hours(events(spark, d), "user_id", "ts", "value").withColumn("value", rounded("value"))


@query(f"""WITH {E} SELECT user_id, h, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY ts, event_id) AS rn FROM e) WHERE rn = 1""")
def first_in_hour(spark, d):
    """WIN-02."""
    return windows.first_in_hour(events(spark, d), "user_id", "ts", "event_id").select("user_id", "h", "event_id", "value")


@query(f"""WITH {E}, p AS (SELECT *, lag(value) OVER w AS previous_value, lag(s) OVER w AS previous_s FROM e WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)), g AS (SELECT *, coalesce((s - previous_s) / 60.0::DOUBLE, 0) AS gap FROM p)
SELECT event_id, previous_value, round(gap, 6) AS turnaround_buffer, CAST(gap < 30 AS INT) AS is_tight, CAST(gap < 15 AS INT) AS is_very_tight,
CASE WHEN gap < 15 THEN 'very_tight' WHEN gap < 30 THEN 'tight' WHEN gap < 60 THEN 'normal' WHEN gap < 120 THEN 'comfortable' ELSE 'very_comfortable' END AS turnaround_category FROM g""")
def previous_event_gaps(spark, d):
    """WIN-05, WIN-06, WIN-07."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    e = windows.previous(e, {"value": "previous_value", "s": "previous_s"}, ["user_id", "day"], ["ts", "event_id"])
    gap = F.coalesce((F.col("s") - F.col("previous_s")) / F.lit(60.0), F.lit(0.0))
    made = windows.gap_flags(gap)
    return e.withColumns(made).select("event_id", "previous_value", rounded("turnaround_buffer").alias("turnaround_buffer"), *list(made)[1:])


@query(f"WITH {E} SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS value_delta FROM e")
def event_deltas(spark, d):
    """WIN-08."""
    e = events(spark, d)
    return windows.deltas(e, ["value"], ["user_id"], ["ts", "event_id"], bucket=windows.bucket_of(e, "ts")).select("event_id", rounded("value_delta").alias("value_delta"))


@query("""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS customer_orders, CASE WHEN count(*) OVER (PARTITION BY o_custkey) >= 15 THEN 'high' WHEN count(*) OVER (PARTITION BY o_custkey) >= 8 THEN 'medium' ELSE 'low' END AS popularity FROM orders""")
def customer_popularity(spark, d):
    """WIN-01, FN-25."""
    x = windows.partition_counts(table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"customer_orders": "o_custkey"})
    return x.select("o_orderkey", "customer_orders", at_least("customer_orders", [(15, "high"), (8, "medium")], "low").alias("popularity"))
