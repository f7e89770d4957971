"""Queries of the profiling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.flags import flag
from tidewater.operators import clean, profiling, ranks, schema
from tidewater.plans.registry import query, rounded, table


@query("SELECT count(*) AS total, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS flagged, count(*) - CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS others, round(avg((o_orderstatus = 'F')::INT) * 100, 2) AS pct, round((count(*) - sum((o_orderstatus = 'F')::INT)) / sum((o_orderstatus = 'F')::INT)::DOUBLE, 2) AS ratio FROM orders")
def class_balance(spark, d):
    """AGG-04."""
    x = profiling.class_balance(table(spark, d, "orders").withColumn("f", flag(F.col("o_orderstatus") == "F")), "f")
    return x.select("total", F.col("flagged").cast("long"), F.col("others").cast("long"), F.col("pct").cast("double"), F.col("ratio").cast("double"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY 1")
def distinct_customers(spark, d):
    """AGG-05."""
    return profiling.distinct_by(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def event_frequencies(spark, d):
    """AGG-06."""
    return profiling.frequencies(table(spark, d, "events"), "event_type")


@query("""SELECT l_shipmode AS l_linestatus, n0, n1, round((n1 + 1.0::DOUBLE) / (n0 + n1 + 2), 6) AS smoothed_rate FROM (SELECT l_linestatus AS l_shipmode, count(*) FILTER (l_returnflag <> 'R') AS n0, count(*) FILTER (l_returnflag = 'R') AS n1 FROM lineitem GROUP BY 1)""")
def smoothed_return_rates(spark, d):
    """AGG-07."""
    x = profiling.smoothed_rates(table(spark, d, "lineitem").withColumn("f", flag(F.col("l_returnflag") == "R")), "l_linestatus", "f")
    return x.withColumn("smoothed_rate", rounded("smoothed_rate"))


COLUMNS = {"event_id": "numeric", "ts": "date", "user_id": "category", "event_type": "textual", "value": "numeric", "props": "textual"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, CAST(count({c}) AS DOUBLE) / count(*) AS completeness, count(DISTINCT {c}) AS n_distinct FROM events" for c, k in COLUMNS.items()))
def events_metadata(spark, d):
    """AGG-08, AGG-09."""
    return profiling.column_metadata(table(spark, d, "events"), {"user_id": "category"})


@query("SELECT 'value' AS \"column\", count(*) FILTER (event_type = 'error') AS n_missing FROM events UNION ALL SELECT 'props', count(*) FILTER (event_type = 'view') FROM events UNION ALL SELECT 'event_id', count(*) FILTER (event_id IS NULL) FROM events")
def missing_values(spark, d):
    """AGG-10: NaN and blanks count as missing."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("value"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("props")).alias("props"))
    return profiling.missing_counts(e)


MIXED = "CASE event_type WHEN 'error' THEN 'M' WHEN 'signup' THEN NULL WHEN 'click' THEN '' WHEN 'view' THEN event_type ELSE CAST(value AS {0}) END"


@query(f"""SELECT 't' AS "column", count(*) FILTER (t IS NULL) AS n_null, count(*) FILTER (t = '') AS n_empty, count(*) FILTER (TRY_CAST(t AS DOUBLE) IS NOT NULL) AS n_numeric, count(*) FILTER (t <> '' AND TRY_CAST(t AS DOUBLE) IS NULL) AS n_other,
  count(*) FILTER (t = 'M') AS "n_M", 0::BIGINT AS n_s, round(avg((TRY_CAST(t AS DOUBLE) IS NOT NULL)::INT) FILTER (t <> ''), 6) AS numeric_share FROM (SELECT {MIXED.format('VARCHAR')} AS t FROM events)""")
def text_profile(spark, d):
    """AGG-11."""
    e = table(spark, d, "events").select(F.expr(MIXED.format("STRING")).alias("t"))
    return profiling.text_profile(e, ["t"]).withColumn("numeric_share", rounded("numeric_share"))


@query(f"""SELECT 't' AS "column", count(*) FILTER (t NOT IN ('M') AND TRY_CAST(t AS DOUBLE) IS NULL) AS n_odd, count(*) FILTER (t NOT IN ('M') AND TRY_CAST(t AS DOUBLE) IS NULL) = 0 AS conforms FROM (SELECT {MIXED.format('VARCHAR')} AS t FROM events)""")
def marker_or_numeric(spark, d):
    """AGG-12."""
    return profiling.marker_or_numeric(table(spark, d, "events").select(F.expr(MIXED.format("STRING")).alias("t")), ["t"])


@query(f"""SELECT 't' AS "column", 'double' AS type, count(t) AS n_values, count(*) FILTER (t IS NOT NULL AND TRY_CAST(t AS DOUBLE) IS NULL) AS n_invalid FROM (SELECT {MIXED.format('VARCHAR')} AS t FROM events)""")
def format_check(spark, d):
    """AGG-13."""
    return profiling.format_check(table(spark, d, "events").select(F.expr(MIXED.format("STRING")).alias("t")), {"t": "double"})


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max FROM lineitem" for c in NUMBERS))
def item_summary(spark, d):
    """AGG-14."""
    x = profiling.summary(table(spark, d, "lineitem"), NUMBERS)
    return x.withColumns({c: rounded(c, 4) for c in ("mean", "std", "q1", "median", "q3")})


@query("""WITH n AS (SELECT count(o_totalprice) AS n FROM orders), p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p),
x AS (SELECT p, n, (SELECT quantile_disc(o_totalprice, 0.5) FROM orders) AS middle FROM p, n)
SELECT p, n, true AS within, CAST(floor(p * 20) AS BIGINT) AS twentieth, CAST(CASE WHEN p = 0.5 THEN (SELECT count(*) FROM orders WHERE o_totalprice <= middle) ELSE 0 END AS BIGINT) AS upto_middle FROM x""")
def price_quantiles(spark, d):
    """AGG-15: quantiles whose ranks, counted again, are within the stated error; the exact median beside them."""
    o = table(spark, d, "orders")
    found = profiling.quantile_ranks(o, "o_totalprice", profiling.quantiles(o, "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95]))
    exact = o.sparkSession.createDataFrame([(0.5, ranks.values_at(o, "o_totalprice", ranks=[(o.count() - 1) // 2])[(o.count() - 1) // 2])], "p double, value double")
    upto = profiling.quantile_ranks(o, "o_totalprice", exact).select("p", F.col("upto").alias("upto_middle"))
    return found.join(upto, "p", "left").select("p", "n", "within", F.floor(F.col("p") * 20).alias("twentieth"), F.coalesce("upto_middle", F.lit(0)).alias("upto_middle"))


SKETCHED = ["user_id", "event_type", "props"]


@query(f"""WITH x AS ({" UNION ALL ".join(f"SELECT CAST(ts AS DATE) AS day, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM events" for c in SKETCHED)})
SELECT c AS "column", count(*) AS n, count(v) AS n_full, true AS within FROM x GROUP BY 1""")
def sketched_distincts(spark, d):
    """AGG-05, AGG-08, AGG-17: distinct counts from sketches stored by day and merged, within four standard errors of
    the exact counts, which are made by pairs of column and value."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    merged = profiling.distinct_from(profiling.distinct_sketches(e, SKETCHED, ["day"]), SKETCHED)
    exact = profiling.distinct_exact(e, SKETCHED).select("column", F.col("n_distinct").alias("exact"))
    error = F.abs(F.col("n_distinct") - F.col("exact")) / F.greatest(F.col("exact"), F.lit(1))
    return merged.join(exact, "column").select("column", "n", "n_full", (error <= 4 * profiling.sketch_error()).alias("within"))


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM lineitem" for a, b in [*PAIRS, *((c, c) for c in NUMBERS)]))
def item_correlations(spark, d):
    """AGG-16."""
    return profiling.correlations(table(spark, d, "lineitem"), NUMBERS).withColumn("corr", rounded("corr", 4))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 32 AS overflows FROM part" for c in ("p_brand", "p_type", "p_name")))
def part_cardinalities(spark, d):
    """AGG-17."""
    return profiling.cardinalities(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, strftime(o_orderdate, '%Y-%m') IN (SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE month(l_shipdate) < 7) AS covered FROM orders GROUP BY ALL")
def month_coverage(spark, d):
    """AGG-18."""
    return profiling.month_coverage(table(spark, d, "orders"), "o_orderdate", table(spark, d, "lineitem").filter(F.month("l_shipdate") < 7), "l_shipdate")


@query("""WITH c AS (SELECT count(*) AS n0, count(*) FILTER (o_totalprice > 50000) AS n1, count(*) FILTER (o_totalprice > 50000 AND o_orderstatus = 'F') AS n2 FROM orders)
SELECT 1 AS step, 'price' AS name, n0 AS before, n1 AS after, n1 / n0::DOUBLE AS kept FROM c UNION ALL SELECT 2, 'status', n1, n2, n2 / n1::DOUBLE FROM c""")
def filter_steps(spark, d):
    """AGG-20."""
    return profiling.step_counts(table(spark, d, "orders"), {"price": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus") == "F"})


@query("SELECT event_id, CAST(value IS NULL AS INT) AS value_missing FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)")
def missing_flags(spark, d):
    """NUL-06: flags for the columns with a tenth or more missing."""
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    out = clean.MissingFlags(0.1).fit(e).transform(e)
    return out.select("event_id", *[c for c in out.columns if c.endswith("_missing")])


@query("SELECT event_type, count(*) AS n, CAST(sum((value > 10)::INT) AS BIGINT) AS is_large FROM events GROUP BY 1")
def normalized_schema(spark, d):
    """SCH-01 to SCH-05: types found, booleans made numbers, the result required and summed."""
    e = schema.normalize(table(spark, d, "events").select("event_type", (F.col("value") > 10).alias("is_large")))
    flags = schema.column_types_by_name(e)["boolean"]
    return schema.require(e, {"is_large": "int"}).groupBy("event_type").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in flags])
