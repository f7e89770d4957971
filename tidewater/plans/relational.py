"""Queries of cleaning, joining, sampling and set operators over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.flags import dataset_flags, delay_explanations, delay_labels, delay_targets, flag
from tidewater.operators import clean, joins, profiling, sampling
from tidewater.operators.windows import bucket_of
from tidewater.plans.registry import longs, query, rounded, table


def late_items(spark, d):
    """Line items with their order's date and the days to shipment as a delay."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    return li.join(o, li.l_orderkey == o.o_orderkey).withColumn("delay", F.datediff("l_shipdate", "o_orderdate").cast("double"))


LATE = """late AS (SELECT l.*, o.o_custkey, o.o_orderdate, o.o_orderpriority, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS delay
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"""


@query(f"""WITH {LATE} SELECT CAST(month(o_orderdate) AS INT) AS month, count(*) AS n, CAST(sum(CASE WHEN delay >= 60 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  round(avg(CASE WHEN delay >= 60 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM late GROUP BY 1""")
def late_rate_by_month(spark, d):
    """Step 0: scan, join, delay, threshold flag, rate by calendar month, ordered."""
    x = late_items(spark, d).withColumn("is_late", flag(F.col("delay") >= 60))
    return profiling.rate_by(x, [F.month("o_orderdate").alias("month")], "is_late").withColumn("rate", rounded("rate"))


@query(f"""WITH {LATE} SELECT o_orderpriority, l_linestatus, count(*) AS n, CAST(sum(CASE WHEN delay >= 15 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  round(avg(CASE WHEN delay >= 15 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM late GROUP BY 1, 2""")
def late_rate_by_priority(spark, d):
    x = late_items(spark, d).withColumn("is_late", flag(F.col("delay") >= 15))
    return profiling.rate_by(x, ["o_orderpriority", "l_linestatus"], "is_late").withColumn("rate", rounded("rate"))


CAUSES_SQL = f"""{LATE}, c AS (SELECT l_orderkey, l_linenumber, l_suppkey, delay AS total, CASE WHEN l_discount > 0.05 THEN l_quantity END AS weather,
  CASE WHEN l_tax > 0.02 THEN round(l_tax * 1000) END AS nas FROM late), f AS (SELECT *, coalesce(total, 0) AS t, coalesce(weather, 0) AS w, coalesce(nas, 0) AS n FROM c)"""


def causes(spark, d):
    return late_items(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", F.col("delay").alias("total"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("weather"), F.when(F.col("l_tax") > 0.02, F.round(F.col("l_tax") * 1000)).alias("nas"))


@query(f"""WITH {CAUSES_SQL} SELECT CAST(sum(CASE WHEN t > 0 AND (abs(t-w-n) <= 0.0500001 OR abs(t-w) <= 0.0500001 OR abs(t-n) <= 0.0500001) THEN 1 ELSE 0 END) AS BIGINT) AS "D1",
  {", ".join(f'CAST(sum(CASE WHEN w > 0 OR n >= {k} THEN 1 ELSE 0 END) AS BIGINT) AS "D2_{k}"' for k in (15, 30, 45, 60, 90))},
  CAST(sum(CASE WHEN w > 0 OR n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS "D3", CAST(sum(CASE WHEN t > 0 THEN 1 ELSE 0 END) AS BIGINT) AS "D4" FROM f""")
def label_dataset_flags(spark, d):
    """LBL-01, as counts."""
    made = dataset_flags("total", "weather", "nas")
    return clean.with_columns(causes(spark, d), made).agg(*[F.sum(c).alias(c) for c in made])


@query(f"""WITH {CAUSES_SQL} SELECT l_suppkey, count(*) AS n, CAST(sum((t >= 15)::INT) AS BIGINT) AS is_delayed_15, CAST(sum((t >= 90)::INT) AS BIGINT) AS is_delayed_90,
  CAST(sum((weather IS NULL)::INT) AS BIGINT) AS weather_was_missing, CAST(sum((w > 0)::INT) AS BIGINT) AS has_weather_delay, CAST(sum((t <= 0)::INT) AS BIGINT) AS is_on_time,
  CAST(sum((t < 0)::INT) AS BIGINT) AS is_early FROM f GROUP BY 1""")
def label_delays(spark, d):
    """LBL-03, as counts by supplier."""
    names = ["is_delayed_15", "is_delayed_90", "weather_was_missing", "has_weather_delay", "is_on_time", "is_early"]
    return clean.with_columns(causes(spark, d), delay_labels("total", "weather", "nas")).groupBy("l_suppkey").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])


@query(f"""WITH {CAUSES_SQL}, r AS (SELECT *, CASE WHEN w > 0 THEN w + n * 0.5 WHEN n > 30 THEN n * 0.3 ELSE 0 END AS related FROM f)
SELECT l_suppkey, round(sum(w), 4) AS weather_only_delay, round(sum(w + n), 4) AS weather_nas_delay, round(sum(related), 4) AS weather_related_delay,
  CAST(sum((related >= 30)::INT) AS BIGINT) AS is_weather_related_delayed_30, CAST(sum((w + n >= 45)::INT) AS BIGINT) AS is_weather_nas_delayed_45, CAST(sum((w + n >= 15)::INT) AS BIGINT) AS label FROM r GROUP BY 1""")
def label_targets(spark, d):
    """LBL-04, LBL-02, as sums by supplier."""
    x = clean.with_columns(causes(spark, d), delay_targets("total", "weather", "nas"))
    return x.groupBy("l_suppkey").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("weather_only_delay", "weather_nas_delay", "weather_related_delay")], *[F.sum(c).alias(c) for c in ("is_weather_related_delayed_30", "is_weather_nas_delayed_45", "label")])


@query(f"""WITH {CAUSES_SQL}, e AS (SELECT *, CASE WHEN w >= n THEN 'weather' WHEN n > 0 THEN 'nas' ELSE 'other' END AS dominant_delay_type,
  CASE WHEN t >= 90 THEN 'critical' WHEN t >= 60 THEN 'severe' WHEN t >= 30 THEN 'moderate' WHEN t >= 15 THEN 'minor' ELSE 'none' END AS delay_severity FROM f)
SELECT dominant_delay_type, delay_severity, count(*) AS n, CAST(sum((w > 0 AND n > 0)::INT) AS BIGINT) AS is_mixed_delay,
  round(avg(CASE WHEN w > 0 THEN n / (w + 1) ELSE 0 END), 6) AS cascading_score, round(avg(CASE WHEN t > 0 THEN w / t * 100 ELSE 0 END), 4) AS weather_contribution_pct FROM e GROUP BY 1, 2""")
def label_explanations(spark, d):
    """LBL-05, AGG-19."""
    x = clean.with_columns(causes(spark, d), delay_explanations("total", "weather", "nas"))
    return x.groupBy("dominant_delay_type", "delay_severity").agg(F.count("*").alias("n"), F.sum("is_mixed_delay").alias("is_mixed_delay"), rounded(F.avg("cascading_score")).alias("cascading_score"), rounded(F.avg("weather_contribution_pct"), 4).alias("weather_contribution_pct"))


@query("""SELECT cn.n_name AS cust_nation, sn.n_name AS supp_nation, count(*) AS n, round(sum(l_extendedprice), 2) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""")
def enrich_two_roles(spark, d):
    """JOIN-01: the nation dimension in two roles."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    x = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = joins.enrich_roles(x, table(spark, d, "nation"), "n_nationkey", {"c_nationkey": "cust_", "s_nationkey": "supp_"}, {"n_name": "nation"})
    return x.groupBy("cust_nation", "supp_nation").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT * EXCLUDE (o_orderdate), epoch(o_orderdate)::BIGINT AS ordered FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def orders_of_segment(spark, d):
    """JOIN-02."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return joins.having_keys(o, c, "c_custkey", ["o_custkey"]).withColumn("ordered", F.unix_timestamp("o_orderdate")).drop("o_orderdate")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_quantity > 49)")
def orders_in_covered_months(spark, d):
    """JOIN-03, FN-12."""
    x = joins.in_covered_months(table(spark, d, "orders"), "o_orderdate", table(spark, d, "lineitem").filter("l_quantity > 49"), "l_shipdate")
    return x.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9900)")
def nations_used(spark, d):
    """JOIN-04: a dimension kept to the keys that either of two roles uses."""
    c = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").filter("s_acctbal > 9900").select(F.col("s_nationkey").alias("k"))
    return joins.used_by_roles(table(spark, d, "nation"), "n_nationkey", sampling.union_all([c, s]), ["k"]).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orders_of_unknown_customers(spark, d):
    """JOIN-07."""
    return joins.unknown_keys(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def reconciled_orders(spark, d):
    """JOIN-12: orders against a copy of themselves with dates as text in another format."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    other = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.date_format("o_orderdate", "M/d/yyyy").alias("on"))
    return joins.reconcile(o, other, {"o_orderkey": "k", "o_custkey": "c"}, "o_orderdate", "on").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT * EXCLUDE (l_shipdate, rn), epoch(l_shipdate)::BIGINT AS shipped FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""")
def deduplicated_items(spark, d):
    """DED-01."""
    return clean.first_per_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("shipped", F.unix_timestamp("l_shipdate")).drop("l_shipdate")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)""")
def orders_within_iqr(spark, d):
    """FLT-05 with half the usual margin, so that some rows go."""
    return clean.within_iqr(table(spark, d, "orders"), "o_totalprice", 0.5).select("o_orderkey", "o_totalprice")


@query("""SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CAST(event_type = 'error' AS INT) AS value_missing,
  coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, -1.0) AS value_filled, TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INT) AS code FROM events WHERE user_id > 0 AND event_type <> 'signup'""")
def cleaned_events(spark, d):
    """PRJ-01, PRJ-02, FLT-01, FLT-03, NUL-01, NUL-04, NUL-05 over events with errors as missing values."""
    e = table(spark, d, "events").filter("event_type <> 'signup'").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    e = clean.sane_rows(clean.drop_nulls(e, ["user_id", "ts"]), [], ["user_id"])
    e = clean.with_missing_flag(e.withColumn("value_filled", F.col("value")), "value")
    return clean.convert_types(clean.fill(e, {"value_filled": -1.0}).withColumn("code", clean.code_number("props")), {"code": "int"}).select("event_id", "user_id", "value", "value_missing", "value_filled", "code")


@query("""SELECT event_id, CASE WHEN t = '' THEN NULL WHEN upper(t) = 'T' THEN 0.0 ELSE TRY_CAST(t AS DOUBLE) END AS amount, CASE WHEN t = 'M' THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS marked
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'M' WHEN 'signup' THEN 'T' WHEN 'view' THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS t FROM events)""")
def normalized_text_numbers(spark, d):
    """NUL-02, NUL-03 over numbers in text with markers, made from event types."""
    t = F.expr("CASE event_type WHEN 'error' THEN 'M' WHEN 'signup' THEN ' T' WHEN 'view' THEN ' ' ELSE concat(' ', CAST(CAST(floor(value) AS BIGINT) AS STRING)) END")
    e = table(spark, d, "events").withColumn("t", t)
    return e.select("event_id", clean.precipitation("t").alias("amount"), clean.marked_missing("t").alias("marked"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM e""")
def filled_along(spark, d):
    """NUL-07, WIN-09."""
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return clean.fill_along(e, ["value"], ["user_id"], ["ts", "event_id"], bucket_of(e, "ts")).select("event_id", "value")


@query("SELECT s AS side, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS s FROM orders UNION ALL SELECT 'a' FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def union_bags(spark, d):
    """SET-01, SET-02."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("side"))
    return sampling.union_all([o, o.filter("side = 'a'")]).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def nations_without_rich_suppliers(spark, d):
    """SET-03, SET-04."""
    c = sampling.distinct(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")))
    return sampling.difference(c, table(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, d):
    """SRT-01, SRT-02: a top-k report."""
    return sampling.top_k(table(spark, d, "orders"), "o_totalprice", 20, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT value, CAST(TRY_CAST(value AS DOUBLE) IS NOT NULL AS INT) AS is_number FROM (SELECT DISTINCT regexp_extract(o_orderpriority, '[A-Z0-9 -]+$') AS value FROM orders UNION SELECT DISTINCT CAST(p_size AS VARCHAR) FROM part) ORDER BY 2, 1 LIMIT 10")
def first_priority_values(spark, d):
    """SRT-03: the first ten values, a report."""
    v = table(spark, d, "orders").select(F.col("o_orderpriority").alias("v")).unionByName(table(spark, d, "part").select(F.col("p_size").cast("string").alias("v")))
    return sampling.first_values(v, "v")


@query("""WITH c AS (SELECT count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2))
SELECT 'train' AS side, 1 AS label, CAST(floor(p * 0.75) AS BIGINT) AS n FROM c UNION ALL SELECT 'train', 0, CAST(least(floor(p * 0.75), n) AS BIGINT) FROM c
UNION ALL SELECT 'test', 1, CAST(p - floor(p * 0.75) AS BIGINT) FROM c UNION ALL SELECT 'test', 0, CAST(least(p - floor(p * 0.75), n - floor(p * 0.75)) AS BIGINT) FROM c""")
def balanced_split_sizes(spark, d):
    """SMP-01, SMP-02: sizes by side and class; a key on both sides would be counted twice in ``test``."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f")).withColumn("label", flag(F.col("f") == "R"))
    train, test = sampling.balanced_train_test(x, "label", ["l_orderkey", "l_linenumber"])
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.dropDuplicates(["l_orderkey", "l_linenumber"]).groupBy("side", "label").agg(F.count("*").alias("n"))


@query("SELECT least(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus <> 'F')) AS n1, least(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus <> 'F')) AS n0 FROM orders")
def balanced_set_size(spark, d):
    """SMP-03."""
    o = table(spark, d, "orders").withColumn("label", flag(F.col("o_orderstatus") == "F"))
    return sampling.balanced(o, "label", ["o_orderkey"]).agg(F.count(F.when(F.col("label") == 1, 1)).alias("n1"), F.count(F.when(F.col("label") == 0, 1)).alias("n0"))


def hash_sql(key: str, purpose: str = "") -> str:
    return f"(CAST('0x' || substr(md5({key} || '|{purpose}42'), 1, 15) AS BIGINT))"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS label, {hash_sql('o_orderkey', 'thin')} / 1152921504606846976::DOUBLE AS thin, {hash_sql('o_orderkey', 'split')} / 1152921504606846976::DOUBLE AS side, {hash_sql('o_orderkey', 'fold')} % 5 AS f FROM orders)
SELECT label, CAST(CASE WHEN side < 0.8 THEN f ELSE -1 END AS INT) AS fold, count(*) AS n FROM o WHERE label = 1 OR thin < 0.5 GROUP BY ALL""")
def under_sampled_orders(spark, d):
    """SMP-04, SMP-05, SMP-06: one class thinned, the rest split and given folds."""
    o = table(spark, d, "orders").withColumn("label", flag(F.col("o_orderstatus") == "F"))
    kept, rest = sampling.split(sampling.under_sample(o, "label", {0: 0.5}, ["o_orderkey"]), 0.8, ["o_orderkey"])
    folded = sampling.with_fold(kept, 5, ["o_orderkey"]).unionByName(rest.withColumn("fold", F.lit(-1)))
    return folded.groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("SELECT 1000 AS n, 1000 AS n_distinct")
def exact_sample(spark, d):
    """SMP-01, SMP-07: a sample of exactly 1,000."""
    return longs(sampling.sample_n(table(spark, d, "orders"), 1000, ["o_orderkey"]).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_distinct")), "n", "n_distinct").select(F.col("n").cast("int"), F.col("n_distinct").cast("int"))
