"""Queries of the composite pipelines: flights made from orders and customers, observations from events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewater.ml import training
from tidewater.plans import pipelines
from tidewater.plans.registry import query, table
from tidewater.plans.relational import hash_sql
from tidewater.sources import WEATHER, scratch, write_table

STATIONS = 25
EXPERIMENT = pipelines.Experiment(
    "orders", {"dep_hour": "None", "distance_score": "StandardScaler"}, ["visibility_miles", "ceiling", "DryBulbCelsius"],
    {"ceiling": "min"}, target="D2_60", origin_depth=3, dest_depth=2, params={"numTrees": 5, "maxDepth": 4}, folds=2,
)

FLIGHTS = """f AS (SELECT o_orderkey, DATE '2024-01-01' + CAST((dayofyear(o_orderdate) - 1) % 30 AS INT) AS day, c_nationkey + 1 AS origin, CAST(o_custkey % 25 AS INT) + 1 AS dest,
  CAST(o_orderkey % 24 AS INT) * 60 + CAST(o_custkey % 60 AS INT) AS minutes, o_totalprice / 1000 - 60 AS late, o_orderstatus = 'P' AS cancelled, o_orderstatus = 'O' AS by_weather FROM orders JOIN customer ON o_custkey = c_custkey)"""


def flights(spark, d):
    """An order is a flight from the customer's nation; its price gives the delay, its status the cause, its
    keys the time."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    late = F.greatest(F.lit(0.0), F.col("o_totalprice") / 1000 - 60)
    return o.select(
        F.expr("date_add(DATE '2024-01-01', CAST((dayofyear(o_orderdate) - 1) % 30 AS INT))").alias("FL_DATE"), F.col("c_nationkey").alias("OP_CARRIER_AIRLINE_ID"), F.col("o_orderkey").cast("int").alias("OP_CARRIER_FL_NUM"),
        (F.col("c_nationkey") + 1).alias("ORIGIN_AIRPORT_ID"), F.expr("CAST(o_custkey % 25 AS INT) + 1").alias("DEST_AIRPORT_ID"), F.expr("CAST(o_orderkey % 24 AS INT) * 100 + CAST(o_custkey % 60 AS INT)").alias("CRS_DEP_TIME"),
        late.alias("ARR_DELAY_NEW"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("CANCELLED"), F.lit(0).alias("DIVERTED"), F.expr("CAST(60 + o_custkey % 180 AS DOUBLE)").alias("CRS_ELAPSED_TIME"),
        F.when(F.col("o_orderstatus") == "O", late).alias("WEATHER_DELAY"), F.when(F.col("o_orderstatus") != "O", late).alias("NAS_DELAY"),
    )


def airports(spark, d):
    n = table(spark, d, "nation")
    return n.select((F.col("n_nationkey") + 1).alias("AirportID"), (F.col("n_nationkey") + 1).cast("string").alias("WBAN"), (-F.col("n_regionkey") - 4).cast("int").alias("TimeZone"))


def weather(spark, d):
    """An event is an observation of one of 25 stations; its type gives the sky, its value the rest."""
    sky = F.expr("CASE event_type WHEN 'error' THEN 'OVC005' WHEN 'view' THEN 'BKN020' WHEN 'click' THEN 'FEW025' ELSE 'CLR' END")
    known = {
        "WBAN": F.expr("CAST(user_id % 25 + 1 AS STRING)"), "Date": F.to_date("ts"), "Time": F.date_format("ts", "HHmm"), "SkyCondition": sky,
        "Visibility": F.least(F.lit(10.0), F.col("value") / 20), "DryBulbCelsius": F.col("value") - 50, "DewPointCelsius": F.col("value") - 55,
    }
    return table(spark, d, "events").select(*[known.get(f.name, F.lit(None)).cast("date" if f.name == "Date" else f.dataType).alias(f.name) for f in WEATHER])


@query(f"""WITH {FLIGHTS}, u AS (SELECT f.*, (day - DATE '1970-01-01') * 24 + CAST(floor(minutes / 60) AS INT) + 4 + n_regionkey AS h FROM f JOIN nation ON n_nationkey + 1 = origin)
SELECT CAST(floor(h / 24) AS BIGINT) AS utc_day, CAST(CASE WHEN by_weather THEN late > 0 ELSE late >= 60 END AS INT) AS late_60, count(*) AS n, CAST(sum(h % 24) AS BIGINT) AS hours FROM u WHERE NOT cancelled AND origin <> dest GROUP BY 1, 2""")
def flights_prepared(spark, d):
    """PIP-01: prepared flights by UTC day and label."""
    f = pipelines.preprocess_flights(flights(spark, d), airports(spark, d))
    return f.groupBy(F.floor(F.col("utc_hour_number") / 24).alias("utc_day"), F.col("D2_60").alias("late_60")).agg(F.count("*").alias("n"), F.sum(F.pmod("utc_hour_number", F.lit(24))).alias("hours"))


@query("""SELECT lpad(CAST(user_id % 25 + 1 AS VARCHAR), 5, '0') AS station, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour_number, min(strftime(ts, '%H%M')) AS first_time, count(*) > 0 AS kept FROM events GROUP BY 1, 2""")
def weather_prepared(spark, d):
    """PIP-02: prepared observations, the first of each station and hour."""
    w = pipelines.preprocess_weather(weather(spark, d))
    return w.select(F.col("WBAN").alias("station"), "hour_number", F.col("Time").alias("first_time"), F.col("visibility_miles").isNotNull().alias("kept"))

def _prepared(origin_depth: int, dest_depth: int, label: str = "CASE WHEN o_orderstatus = 'O' THEN late > 0 ELSE late >= 60 END") -> str:
    """The flights and observations of the pipelines, labelled, balanced into parts, with the observations before them: tables
    ``r`` (all balanced flights) and ``j`` (those with an observation on both sides: o1, o2 ... of the origin, d1 ... of the other)."""
    hours = [(f"{side}{i}", key, at, i) for side, key, at, depth in (("o", "origin", "h", origin_depth), ("d", "dest", "ah", dest_depth)) for i in range(1, depth + 1)]
    seen = " ".join(f"LEFT JOIN w {n} ON {n}.station = r.{key} AND {n}.hour = r.{at} - {i}" for n, key, at, i in hours)
    some = " AND ".join("(" + " OR ".join(f"{n}.station IS NOT NULL" for n, *_ in hours if n[0] == side) + ")" for side in "od")
    picks = ", ".join(f"{n}.ceiling AS ceiling_{n}, {n}.risk AS risk_{n}, {n}.station IS NOT NULL AS is_{n}" for n, *_ in hours)
    return f"""g AS (SELECT o_orderkey, o_custkey, DATE '2024-01-01' + CAST((dayofyear(o_orderdate) - 1) % 30 AS INT) AS day, c_nationkey + 1 AS origin, CAST(o_custkey % 25 AS INT) + 1 AS dest, c_nationkey,
  greatest(0, o_totalprice / 1000 - 60) AS late, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_nationkey + 1 <> CAST(o_custkey % 25 AS INT) + 1),
w0 AS (SELECT CAST(user_id % 25 AS INT) + 1 AS station, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, strftime(ts, '%H%M') AS t, least(10.0::DOUBLE, value / 20) AS v,
  CASE event_type WHEN 'error' THEN 'OVC005' WHEN 'view' THEN 'BKN020' WHEN 'click' THEN 'FEW025' ELSE 'CLR' END AS sky, CAST(ts AS DATE) AS date FROM events),
w1 AS (SELECT station, hour, min({{'t': t, 'sky': sky, 's': CAST(v AS VARCHAR), 'v': v}}) AS x FROM w0 GROUP BY 1, 2),
w AS (SELECT station, hour, CASE x.sky WHEN 'OVC005' THEN 500 WHEN 'BKN020' THEN 2000 ELSE 99999 END AS ceiling,
  CASE WHEN x.v < 0.5 THEN 5.0 WHEN x.v < 1 THEN 4.0 WHEN x.v < 3 THEN 3.0 WHEN x.v < 5 THEN 2.0 WHEN x.v < 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS risk FROM w1),
u AS (SELECT g.*, CAST(o_orderkey % 24 AS INT) AS dep_hour, (day - DATE '1970-01-01') * 24 + CAST(o_orderkey % 24 AS INT) + 4 + n_regionkey AS h FROM g JOIN nation ON n_nationkey + 1 = origin
  WHERE origin IN (SELECT station FROM w) AND dest IN (SELECT station FROM w) AND strftime(day, '%Y-%m') IN (SELECT strftime(date, '%Y-%m') FROM w0)),
l AS (SELECT *, CAST(floor((h * 60 + o_custkey % 60 + 60 + o_custkey % 180) / 60) AS BIGINT) AS ah, CAST({label} AS INT) AS label,
  strftime(DATE '1970-01-01' + CAST(floor(h / 24) AS INT), '%Y-%m-%d') || '_' || c_nationkey || '_' || o_orderkey || '_' || origin || '_' || dest AS id FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('id')}, id) AS place, count(*) FILTER (label = 1) OVER () AS p FROM l),
r AS (SELECT *, CASE WHEN place <= floor(p * 0.75) THEN 'train' ELSE 'test' END AS part FROM k WHERE place <= p),
j AS (SELECT r.*, {picks} FROM r {seen} WHERE {some})"""


STUMP = pipelines.Experiment(
    "stump", {"dep_hour": "None"}, ["ceiling", "visibility_risk_score"], target="D2_60", origin_depth=2, dest_depth=1, folds=2,
    params={"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all"},
)
COLUMNS = ["dep_hour", *(f"{c}_{h}" for c in ("ceiling", "risk") for h in ("o1", "o2", "d1"))]

#: The whole run again, with delays by weather in the evening only: the best split of one tree of one level by Gini's impurity, for each fold and for all of the
#: training part, and the cells of its predictions.
EVENING = "CASE WHEN o_orderstatus = 'O' THEN late > 0 AND dep_hour >= 16 ELSE late >= 140 END"
STUMP_SQL = f"""WITH {_prepared(2, 1, EVENING)}, m AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in COLUMNS)} FROM j WHERE part = 'train'),
x AS (SELECT j.id, j.part, j.label, {hash_sql('j.id', 'fold')} % 2 AS fold, {', '.join(f'CAST(coalesce(j.{c}, m.{c}) AS DOUBLE) AS {c}' for c in COLUMNS)} FROM j, m),
runs AS (SELECT unnest([0, 1, 2]) AS run),
v AS (SELECT run, x.*, part = 'train' AND run <> fold AS learns, run = 2 OR part = 'train' AND run = fold AS judged FROM x, runs),
f AS ({' UNION ALL '.join(f"SELECT run, {i} AS f, {c} AS val, label FROM v WHERE learns" for i, c in enumerate(COLUMNS))}),
c AS (SELECT run, f, val, count(*) AS n, sum(label) AS y FROM f GROUP BY ALL),
s AS (SELECT *, (val + lead(val) OVER o) / 2 AS cut, CAST(sum(n) OVER o AS DOUBLE) AS ln, CAST(sum(y) OVER o AS DOUBLE) AS ly, CAST(sum(n) OVER a AS DOUBLE) AS an, CAST(sum(y) OVER a AS DOUBLE) AS ay FROM c
  WINDOW o AS (PARTITION BY run, f ORDER BY val), a AS (PARTITION BY run, f)),
q AS (SELECT *, 2 * ay / an * (1 - ay / an) - ln / an * 2 * ly / ln * (1 - ly / ln) - (an - ln) / an * 2 * (ay - ly) / (an - ln) * (1 - (ay - ly) / (an - ln)) AS gain FROM s WHERE cut IS NOT NULL),
b AS (SELECT run, arg_max({{'f': f, 'cut': cut, 'l': CAST(ly * 2 > ln AS INT), 'r': CAST((ay - ly) * 2 > an - ln AS INT)}}, gain) AS t FROM q GROUP BY run),
z AS (SELECT v.run, v.part, v.label, CASE WHEN CASE b.t.f {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(COLUMNS))} END <= b.t.cut THEN b.t.l ELSE b.t.r END AS prediction FROM v JOIN b ON b.run = v.run WHERE judged)
SELECT CASE WHEN run = 2 THEN part ELSE 'fold ' || run END AS part, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM z GROUP BY 1"""


def stump_parts(spark, d):
    some = flights(spark, d)
    by_weather = F.col("WEATHER_DELAY").isNotNull()
    some = some.withColumns({"WEATHER_DELAY": F.when(by_weather & (F.col("CRS_DEP_TIME") >= 1600), F.col("ARR_DELAY_NEW")), "NAS_DELAY": F.when(~by_weather, F.greatest(F.lit(0.0), F.col("ARR_DELAY_NEW") - 80))})
    f, w = pipelines.data_pipeline(some, weather(spark, d), airports(spark, d), [STUMP], scratch(spark, "prepared"))
    return [write_once(spark, x) for x in pipelines.feature_pipeline(f, w, STUMP)]


@query(STUMP_SQL)
def model_run_cells(spark, d):
    """PIP-05, PIP-03, PIP-04, ML-01, ML-02, ML-10, ML-20, ML-24, ML-26, ML-28, ML-29: a whole stored run of a tree of
    one split, which SQL can fit too: the cells of each fold, and those of both parts, counted in the stored predictions."""
    done = pipelines.ml_pipeline(*stump_parts(spark, d), STUMP, scratch(spark, "run"))
    folds = done.candidates.select(F.concat(F.lit("fold "), F.col("fold").cast("string")).alias("part"), *training.CELLS)
    return folds.unionByName(training.confusion(done.predictions, by=["part"]).select("part", *training.CELLS))


@query(f"SELECT * FROM ({STUMP_SQL}) WHERE part IN ('train', 'test')")
def boosted_run_cells(spark, d):
    """ML-21, ML-23, PIP-05 without folds: boosted trees under the other library's parameter names; one round of one
    split decides as the best single split does."""
    boosted = replace(STUMP, model="xgboost", params={"num_round": 1, "max_depth": 1})
    done = pipelines.ml_pipeline(*stump_parts(spark, d), boosted, scratch(spark, "run"), fast=True)
    return training.confusion(done.predictions, by=["part"]).select("part", *training.CELLS)


def write_once(spark, df):
    path = scratch(spark, "part")
    write_table(df, path)
    return spark.read.parquet(path)


PIPELINE_SQL = f"WITH {_prepared(3, 2)} SELECT label AS label_is_delayed, count(*) AS n, count(*) FILTER (is_o1) AS n_hour_before, part FROM j GROUP BY ALL"


@query(PIPELINE_SQL)
def pipeline_features(spark, d):
    """PIP-03, PIP-04: balanced train and test rows with the weather before them."""
    f, w = pipelines.data_pipeline(flights(spark, d), weather(spark, d), airports(spark, d), [EXPERIMENT], scratch(spark, "prepared"))
    train, test = pipelines.feature_pipeline(f, w, EXPERIMENT)
    count = lambda x, name: x.groupBy("label_is_delayed").agg(F.count("*").alias("n"), F.count("origin_weather_visibility_miles_h1").alias("n_hour_before")).withColumn("part", F.lit(name))
    return count(train, "train").unionByName(count(test, "test"))
