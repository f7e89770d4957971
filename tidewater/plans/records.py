"""Queries of samples by member, readers and writers, pruning, leakage guards, flags and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import sources
from tidewater.functions import flags
from tidewater.ml import training
from tidewater.operators import clean, sampling
from tidewater.plans.models import PREDICTED, predicted
from tidewater.plans.registry import query, rounded, table
from tidewater.plans.relational import hash_sql

UNIT = f"{hash_sql('o_orderkey')} / 1152921504606846976::DOUBLE"


@query(f"SELECT o_orderkey FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 500")
def sampled_orders(spark, d):
    """SMP-01, SMP-07: which rows a sample of 500 takes."""
    return sampling.at_most(table(spark, d, "orders"), 500, ["o_orderkey"]).select("o_orderkey")


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {UNIT}, o_orderkey) AS place FROM o)
SELECT o_orderkey, label FROM r WHERE place <= (SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) FROM o)""")
def balanced_orders(spark, d):
    """SMP-03: which rows a balanced set takes."""
    o = table(spark, d, "orders").withColumn("label", flags.flag(F.col("o_orderstatus") == "F"))
    return sampling.balanced(o, "label", ["o_orderkey"]).select("o_orderkey", "label")


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INT) AS label FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {UNIT}, o_orderkey) AS place FROM o),
c AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM o)
SELECT o_orderkey, label, CASE WHEN place <= floor(p * 0.75) THEN 'train' ELSE 'test' END AS side FROM r, c WHERE place <= p""")
def split_orders(spark, d):
    """SMP-02: which rows each side takes."""
    o = table(spark, d, "orders").withColumn("label", flags.flag(F.col("o_orderpriority") == "1-URGENT"))
    train, test = sampling.balanced_train_test(o, "label", ["o_orderkey"])
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test"))).select("o_orderkey", "label", "side")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'a \"' || c_name || '\",' END AS name, CAST(date_trunc('day', TIMESTAMP '1995-01-01') + to_days(CAST(c_custkey % 700 AS INT)) AS DATE) AS day, c_acctbal AS balance FROM customer")
def text_round_trip(spark, d):
    """SRC-01 to SRC-03, SNK-02, SNK-03: customers written as text with quotes and commas and read by a schema,
    a column dropped, dates parsed by their format."""
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('a "'), "c_name", F.lit('",')))
    day = F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int")), "yyyyMMdd")
    path = sources.scratch(spark, "text")
    c.select(F.col("c_custkey").cast("string").alias("id"), name.alias("name"), day.alias("day"), F.col("c_acctbal").alias("balance"), F.lit("x").alias("unused")).write.option("header", True).option("escape", '"').csv(path)
    found = sources.read_csv(spark, path, sources._schema("id string, name string, day string, balance double, unused string"), multi_line=True, date_columns={"day": "yyyyMMdd"}, drop=("unused",))
    return found.withColumn("id", F.col("id").cast("long"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def stored_round_trip(spark, d):
    """SRC-04, SRC-05, SNK-01, SNK-05: orders stored, read back with a check of columns, and asked by SQL."""
    path = sources.scratch(spark, "stored")
    sources.write_table(table(spark, d, "orders"), path)
    sources.register(sources.read_table(spark, None, path, required=["o_orderkey", "o_custkey"]), "stored_orders")
    return spark.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM stored_orders")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def pruned_orders(spark, d):
    """PRJ-03: the essential columns and those that any experiment wants."""
    return clean.prune(table(spark, d, "orders"), [["o_totalprice", "absent"], ["o_orderpriority"]], ["o_orderkey"])


@query("SELECT c_acctbal, c_custkey, c_name FROM customer")
def known_before(spark, d):
    """PRJ-04: without the columns that are known later."""
    return clean.drop_known_later(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query("""WITH o AS (SELECT o_custkey, ((o_orderkey % 24) + 24) % 24 AS hour, o_totalprice FROM orders)
SELECT c_custkey, ((10 - hour) % 24 + 24) % 24 AS hours_before, round(o_totalprice, 6) AS value FROM customer JOIN o ON o_custkey = c_custkey""")
def observations_without_keys(spark, d):
    """PRJ-05: the structs of an array without their key, and how many hours before they were."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.lit("k").alias("key"), F.pmod("o_orderkey", F.lit(24)).alias("hour"), F.col("o_totalprice").alias("value"))).alias("seen"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).withColumn("at", F.lit(10).cast("long"))
    x = clean.strip_observations(c, "seen", ["key"], hour="hour", relative_to="at").select("c_custkey", F.explode("seen").alias("s"))
    return x.select("c_custkey", F.col("s.hours_before").alias("hours_before"), rounded("s.value").alias("value"))


@query("SELECT o_orderkey, CAST(o_totalprice > 1000 AS INT) AS label_a FROM orders")
def guarded_orders(spark, d):
    """PRJ-06: no source columns, no other labels, no identifiers."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", flags.flag(F.col("o_totalprice") > 1000).alias("label_a"), F.lit(1).alias("label_b"))
    return clean.guard_leakage(o, "label_a", ["o_totalprice"], forbidden=["o_custkey"])


@query("""SELECT false AS clean, unnest(['source column o_totalprice', 'label label_b', 'identifier o_custkey', 'target label_a is missing']) AS violation, (SELECT count(*) FROM orders) AS n""")
def leakage_of_orders(spark, d):
    """PRJ-07: what the guard would have to remove, beside the number of rows concerned."""
    o = table(spark, d, "orders").withColumn("label_b", F.lit(1))
    clean_, found = clean.leakage_report(o, "label_a", ["o_totalprice"], ["o_custkey"])
    return o.agg(F.count("*").alias("n")).select(F.lit(clean_).alias("clean"), F.explode(F.array(*map(F.lit, found))).alias("violation"), "n")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS a, CASE WHEN l_linenumber = 2 THEN 1.0 END AS b FROM lineitem) WHERE coalesce(a, 0) = 0 AND coalesce(b, 0) = 0")
def unflagged_items(spark, d):
    """FLT-02: without rows of which any flag is set; null counts as not set."""
    x = table(spark, d, "lineitem").withColumns({"a": F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0), "b": F.when(F.col("l_linenumber") == 2, 1.0)})
    return clean.drop_flagged(x, ["a", "b"]).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE value > 50 OR event_type = 'purchase'")
def events_with_any(spark, d):
    """FLT-04: rows with at least one of several columns."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, 1).alias("a"), F.when(F.col("event_type") == "purchase", 1).alias("b"))
    return clean.any_present(e, ["a", "b"]).select("event_id")


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderkey % 100 >= {t} AS INT) AS late_{t}" for t in (15, 30, 60)) + " FROM orders")
def threshold_labels(spark, d):
    """LBL-06: flags by threshold."""
    o = table(spark, d, "orders").withColumn("minutes", F.col("o_orderkey") % 100)
    return clean.with_columns(o, flags.threshold_flags("minutes", "late", [15, 30, 60])).select("o_orderkey", "late_15", "late_30", "late_60")


RUNS = f"""{PREDICTED}, c AS (SELECT l_returnflag AS experiment, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = prediction) AS hit, count(*) AS n FROM p GROUP BY 1),
m AS (SELECT experiment, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, hit / n::DOUBLE AS accuracy FROM c)"""


def runs(spark, d):
    x = training.metrics(training.confusion(predicted(spark, d), by=["l_returnflag"]))
    return x.withColumnRenamed("l_returnflag", "experiment").withColumn("f1", rounded("f1"))


@query(f"{RUNS} SELECT experiment, round(f1, 6) AS f1, dense_rank() OVER (ORDER BY round(f1, 6) DESC) AS rank FROM m")
def ranked_runs(spark, d):
    """ML-33: experiments by their F1."""
    x = training.compare_runs(runs(spark, d)).select("experiment", "f1", F.col("rank").cast("long").alias("rank"))
    return x


@query(f"""{RUNS}, g AS (SELECT a.accuracy AS train_accuracy, a.f1 AS train_f1, b.accuracy AS test_accuracy, b.f1 AS test_f1 FROM m a, m b WHERE a.experiment = 'A' AND b.experiment = 'R'),
w AS (SELECT *, greatest(abs(train_accuracy - test_accuracy), abs(train_f1 - test_f1)) AS worst FROM g)
SELECT round(train_accuracy, 6) AS train_accuracy, round(train_f1, 6) AS train_f1, round(test_accuracy, 6) AS test_accuracy, round(test_f1, 6) AS test_f1, round(train_accuracy - test_accuracy, 6) AS gap_accuracy, round(train_f1 - test_f1, 6) AS gap_f1,
  CASE WHEN worst > 0.1 THEN 'alert' WHEN worst > 0.05 THEN 'warning' ELSE 'none' END AS overfitting FROM w""")
def gap_between_flags(spark, d):
    """ML-31: how far two sets' measures are apart."""
    x = training.metrics(training.confusion(predicted(spark, d), by=["l_returnflag"]))
    gap = training.train_test_gap(x.filter("l_returnflag = 'A'"), x.filter("l_returnflag = 'R'"))
    return gap.select(*[rounded(c).alias(c) for c in gap.columns if c != "overfitting"], "overfitting")


@query(f"""{PREDICTED}, b AS (SELECT p1, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM p GROUP BY 1), w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
SELECT round(sum(p * (below + n / 2.0))::DOUBLE / (sum(p) * sum(n))::DOUBLE, 6) AS auc_roc FROM w""")
def rule_area(spark, d):
    """ML-30: the area under the curve of a rule's scores."""
    x = predicted(spark, d).select("label", F.col("p1").alias("rawPrediction"))
    return x.sparkSession.createDataFrame([(round(training.areas(x)["auc_roc"], 6),)], "auc_roc double")
