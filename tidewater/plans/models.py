"""Queries of feature pipelines, models and evaluation. Fitted models have no SQL twin; a rule-based
prediction and its measures do."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewater.functions.flags import flag
from tidewater.ml import features, selection, training
from tidewater.plans.registry import query, rounded, table
from tidewater.plans.relational import LATE, late_items
from tidewater.sources import stored

SPEC = features.FeatureSpec({"l_quantity": "None", "l_extendedprice": "StandardScaler", "l_discount": "None", "l_returnflag": "OneHotEncoder", "o_orderpriority": "StringIndexer"}, "label")


def labelled(spark, d):
    return late_items(spark, d).withColumn("label", flag(F.col("l_quantity") * (1 - F.col("l_discount")) > 24))


def labelled_once(spark, d, *columns):
    """Those columns and the label, joined and stored once: each stage and step of a fit reads them again."""
    return stored(labelled(spark, d).select(*columns, "label"), "labelled")


PREDICTED = f"WITH {LATE}, p AS (SELECT *, CAST(l_quantity * (1 - l_discount) > 24 AS INT) AS label, CAST(l_quantity > 25 AS INT) AS prediction, l_quantity / 51 AS p1 FROM late)"


def predicted(spark, d):
    return labelled(spark, d).select("l_returnflag", "label", flag(F.col("l_quantity") > 25).alias("prediction"), (F.col("l_quantity") / 51).alias("p1"))


@query(f"""{PREDICTED}, c AS (SELECT l_returnflag, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM p GROUP BY 1)
SELECT *, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS "precision", round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1,
  round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round(fp / (fp + tn)::DOUBLE, 6) AS fpr, round(tp / (tp + fn)::DOUBLE, 6) AS recall_delayed, round(tn / (tn + fp)::DOUBLE, 6) AS recall_on_time FROM c""")
def rule_metrics(spark, d):
    """ML-29 for a rule-based prediction, by return flag."""
    x = training.metrics(training.confusion(predicted(spark, d), by=["l_returnflag"]))
    return x.select("l_returnflag", "tp", "tn", "fp", "fn", *[rounded(c).alias(c) for c in x.columns[5:]])


@query(f"""{PREDICTED}, b AS (SELECT p1 AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM p GROUP BY 1)
SELECT round(threshold, 6) AS threshold, round(sum(p) OVER w / sum(p) OVER ()::DOUBLE, 6) AS tpr, round(sum(n) OVER w / sum(n) OVER ()::DOUBLE, 6) AS fpr FROM b WINDOW w AS (ORDER BY threshold DESC)""")
def rule_roc(spark, d):
    """ML-32, UDF-01: the curve by threshold."""
    x = training.roc(predicted(spark, d), bins=None)
    return x.select(*[rounded(c).alias(c) for c in x.columns])


@query()
def forest_holdout(spark, d):
    """ML-01, ML-02, ML-10, ML-20, ML-24, ML-29, ML-30: fit on some orders, measure on the others."""
    x = labelled_once(spark, d, "l_orderkey", *SPEC.features)
    train, test = x.filter(F.col("l_orderkey") % 4 != 0), x.filter(F.col("l_orderkey") % 4 == 0)
    e, points = features.extract(train, SPEC)
    model = training.train_final(points, "rf", numTrees=10, maxDepth=4)
    return training.evaluate(model.transform(e.transform(test)))


@query()
def boosted_importances(spark, d):
    """ML-21, ML-23, SRT-02: boosted trees and their importances."""
    _, points = features.extract(labelled_once(spark, d, *SPEC.features), SPEC)
    return training.importances(spark, training.classifier("xgboost", num_round=5, max_depth=3).fit(points))


@query()
def logistic_cross_validation(spark, d):
    """ML-22, ML-25, ML-26, ML-28, SMP-06: a grid by cross validation, then measures per fold. Folds go by the items' keys: the
    last digits of scaled features change with the order in which their mean was summed up."""
    keys, grid = ["l_orderkey", "l_linenumber", "l_suppkey"], {"regParam": [0.01, 0.1]}
    x = labelled_once(spark, d, *keys, *SPEC.features)
    e, _ = features.extract(x, SPEC)
    best, measured = training.cross_validate(e.transform(x, keys), "lr", grid, k=2, keys=keys, maxIter=10)
    return training.summary(measured.filter(F.col("candidate") == training.grid_maps(grid).index(best)))


@query()
def components_by_variance(spark, d):
    """ML-06, ML-07, UDF-04: components that hold most of the variance."""
    _, points = features.extract(labelled_once(spark, d, *SPEC.features), SPEC)
    return features.VariancePCA(variance=0.9).fit(points).variance_table(spark)


@query()
def automatic_features(spark, d):
    """ML-03, ML-04, ML-05, ML-09, UDF-02: stages by column type with dates, a selector and a scaler."""
    from pyspark.ml import Pipeline

    x = labelled_once(spark, d, "l_quantity", "l_discount", "l_returnflag", "o_orderdate")
    made = Pipeline(stages=features.auto_stages(x, "label", scaler="minmax", selector=("anova", 3))).fit(x).transform(x)
    return made.select(F.posexplode(vector_to_array("features")).alias("slot", "v")).groupBy("slot").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query()
def polynomial_regression(spark, d):
    """ML-11, ML-34: a linear model on expanded features."""
    _, points = features.extract(table(spark, d, "lineitem"), features.FeatureSpec({"l_quantity": "StandardScaler", "l_discount": "StandardScaler"}, "l_extendedprice"))
    expanded = features.polynomial().transform(points).select(F.col("expanded").alias("features"), "label")
    _, found = training.linear_regression(expanded, maxIter=10)
    return expanded.agg(F.count("*").alias("n")).withColumns({k: F.lit(v) for k, v in found.items()})


ITEMS = f"""{LATE}, i AS (SELECT l_returnflag, l_linestatus, o_orderpriority, l_quantity, l_discount, l_extendedprice, CAST(l_quantity * (1 - l_discount) > 24 AS INT) AS label FROM late)"""
CATEGORIES, NUMBERS = ["l_returnflag", "l_linestatus", "o_orderpriority"], ["l_quantity", "l_discount", "l_extendedprice"]


def _tests_sql() -> str:
    chi = " UNION ALL ".join(f"""SELECT '{c}' AS "column", 'chi2' AS test, sum(power(o - r * l / n::DOUBLE, 2) / (r * l / n::DOUBLE)) AS statistic, (count(DISTINCT v) - 1) * (count(DISTINCT label) - 1) AS dof FROM (
      SELECT v, label, o, sum(o) OVER (PARTITION BY v) AS r, sum(o) OVER (PARTITION BY label) AS l, sum(o) OVER () AS n FROM (SELECT a.v, b.label, (SELECT count(*) FROM i WHERE i.{c} = a.v AND i.label = b.label) AS o
      FROM (SELECT DISTINCT {c} AS v FROM i) a, (SELECT DISTINCT label FROM i) b))""" for c in CATEGORIES)
    f = " UNION ALL ".join(f"""SELECT '{c}', 'anova', (sum(n * power(m - (SELECT avg({c}) FROM i), 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), count(*) - 1 FROM (SELECT label, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM i GROUP BY 1)""" for c in NUMBERS)
    return f"""WITH {ITEMS}, t AS ({chi} UNION ALL {f})
SELECT "column", test, round(statistic, 4) AS statistic, CAST(dof AS BIGINT) AS dof, statistic > CASE dof WHEN 1 THEN 3.8415 WHEN 2 THEN 5.9915 WHEN 4 THEN 9.4877 END AS selected FROM t"""


@query(_tests_sql())
def feature_tests(spark, d):
    """ML-08, ML-09: chi-square and F statistics of line items' columns against a label, and which columns a share of 5 %
    of false positives keeps (SQL: by the critical values)."""
    x = labelled(spark, d)
    found = selection.selected(selection.tests(x, CATEGORIES, NUMBERS, "label"))
    return found.select("column", "test", F.round("statistic", 4).alias("statistic"), "dof", "selected")


def _regression_sql(a: str, b: str, source: str) -> str:
    """Least squares on two columns in closed form, from the covariances."""
    return f"""WITH v AS ({source}), c AS (SELECT var_pop({a}) AS aa, var_pop({b}) AS bb, covar_pop({a}, {b}) AS ab, covar_pop({a}, y) AS ay, covar_pop({b}, y) AS byy, var_pop(y) AS yy, avg({a}) AS ma, avg({b}) AS mb, avg(y) AS my, count(*) AS n FROM v),
k AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ka, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS kb FROM c)
SELECT n, round(my - ka * ma - kb * mb, 3) AS intercept, round(ka, 3) AS first, round(kb, 3) AS second, round(sqrt(yy - ka * ay - kb * byy), 3) AS rmse, round((ka * ay + kb * byy) / yy, 6) AS r2 FROM k"""


def regressed(points):
    model, found = training.linear_regression(points, solver="normal")
    k = model.coefficients
    return points.agg(F.count("*").alias("n")).select("n", *[F.round(F.lit(float(v)), 3).alias(c) for c, v in (("intercept", model.intercept), ("first", k[0]), ("second", k[1]), ("rmse", found["rmse"]))], F.round(F.lit(found["r2"]), 6).alias("r2"))


@query(_regression_sql("l_quantity", "l_discount", "SELECT l_quantity, l_discount, l_extendedprice AS y FROM lineitem"))
def price_regression(spark, d):
    """ML-34: least squares from one aggregate of products, and its errors."""
    _, points = features.extract(table(spark, d, "lineitem"), features.FeatureSpec({"l_quantity": "None", "l_discount": "None"}, "l_extendedprice"))
    return regressed(points)


@query(_regression_sql("q", "q2", "SELECT l_quantity / 10 AS q, power(l_quantity / 10, 2) AS q2, l_tax * l_quantity AS y FROM lineitem"))
def quadratic_regression(spark, d):
    """ML-11, ML-34: the same on a number and its square, made by polynomial expansion."""
    li = table(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("q"), (F.col("l_tax") * F.col("l_quantity")).alias("y"))
    _, points = features.extract(li, features.FeatureSpec({"q": "None"}, "y"))
    return regressed(features.polynomial().transform(points).select(F.col("expanded").alias("features"), "label"))


@query(f"""WITH {ITEMS}, g AS (SELECT avg(label) FILTER (l_returnflag = 'R') AS p, avg(label) FILTER (l_returnflag <> 'R') AS q FROM i)
SELECT 'returned' AS feature, round(ln(p / (1 - p)) - ln(q / (1 - q)), 4) AS importance FROM g UNION ALL SELECT 'intercept', round(ln(q / (1 - q)), 4) FROM g""")
def logistic_odds(spark, d):
    """ML-22, ML-28: a logistic model of one flag, whose optimum has a closed form: the logarithms of the odds."""
    x = labelled_once(spark, d, flag(F.col("l_returnflag") == "R").alias("returned"))
    _, points = features.extract(x, features.FeatureSpec({"returned": "None"}, "label"))
    found = training.importances(spark, training.train_final(points, "lr", tol=1e-12), ["returned"])
    return found.select("feature", F.round("importance", 4).alias("importance"))


SHARES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(f"""SELECT {len(SHARES)}::BIGINT AS components, round({' + '.join(f'var_samp({c})' for c in SHARES)}, 4) AS variance, 1.0::DOUBLE AS shares, true AS apart, round(var_samp(l_quantity), 4) AS least_first FROM lineitem""")
def component_invariants(spark, d):
    """ML-06, ML-07, UDF-04: of all components: their variances add up to the columns' (the trace), their shares to 1, their
    projections are uncorrelated, and the first varies as much as any column does."""
    _, points = features.extract(table(spark, d, "lineitem"), features.FeatureSpec(dict.fromkeys(SHARES, "None"), "l_extendedprice"))
    pca = features.VariancePCA(variance=1.0).fit(points)
    p = [vector_to_array("pca_features")[i] for i in range(len(pca.shares))]
    pairs = [F.abs(F.covar_samp(a, b)) / F.sqrt(F.var_samp(a) * F.var_samp(b)) for i, a in enumerate(p) for b in p[i + 1 :]]
    row = pca.transform(points).agg(F.round(sum(F.var_samp(c) for c in p), 4).alias("variance"), (F.greatest(*pairs) < 1e-6).alias("apart"), F.var_samp(p[0]).alias("first"), F.var_samp(vector_to_array("features")[0]).alias("quantity"))
    return row.select(F.lit(len(pca.shares)).cast("long").alias("components"), "variance", F.round(F.lit(sum(pca.shares)), 9).alias("shares"), "apart", F.when(F.col("first") >= F.col("quantity") * (1 - 1e-9), F.round("quantity", 4)).alias("least_first"))


#: The place of each value of a text column: the most frequent is 0, equal ones go by their letters.
PLACED = "{0}_p AS (SELECT {0}, row_number() OVER (ORDER BY count(*) DESC, {0}) - 1 AS {0}_ix FROM late GROUP BY 1)"


def slots(df, keys: list[str], names: list[str], vector: str = "features"):
    v = vector_to_array(vector)
    return df.select(*keys, *[F.round(F.get(v, F.lit(i)), 6).alias(n) for i, n in enumerate(names)], F.size(v).cast("long").alias("width"))


@query(f"""WITH {LATE}, {PLACED.format('l_returnflag')}, {PLACED.format('o_orderpriority')}, q AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS gappy FROM late),
m AS (SELECT avg(gappy) AS filled, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd FROM q)
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(o_orderpriority_ix AS DOUBLE) AS priority, {', '.join(f'CAST(l_returnflag_ix = {i} AS INT)::DOUBLE AS flag_{i}' for i in range(3))}, 0.0::DOUBLE AS flag_unknown,
  round(coalesce(gappy, filled), 6) AS quantity, round((l_extendedprice - mean) / sd, 6) AS price, 7::BIGINT AS width FROM q JOIN l_returnflag_p USING (l_returnflag) JOIN o_orderpriority_p USING (o_orderpriority), m""")
def feature_vectors(spark, d):
    """ML-01, ML-02, ML-10: text indexed and one-hot encoded, gaps filled with the mean, one number standardized: every
    slot of every row."""
    some = F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("some")
    x = stored(late_items(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "o_orderpriority", "l_returnflag", some, "l_extendedprice", F.lit(0).alias("label")), "items")
    spec = features.FeatureSpec({"o_orderpriority": "StringIndexer", "l_returnflag": "OneHotEncoder", "some": "None", "l_extendedprice": "StandardScaler", "absent": "None"}, "label")
    made = features.feature_stages(x, spec).fit(x).transform(x)
    return slots(made, ["l_orderkey", "l_linenumber", "l_suppkey"], ["priority", "flag_0", "flag_1", "flag_2", "flag_unknown", "quantity", "price"])


@query(f"""WITH {LATE}, {PLACED.format('l_returnflag')} SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity > 25 AS INT)::DOUBLE AS is_big, l_quantity AS quantity, CAST(l_returnflag_ix AS DOUBLE) AS flag, year(o_orderdate)::DOUBLE AS year, month(o_orderdate)::DOUBLE AS month,
  day(o_orderdate)::DOUBLE AS day, (dayofweek(o_orderdate) + 1)::DOUBLE AS weekday, epoch(date_trunc('day', o_orderdate))::DOUBLE AS unix, 8::BIGINT AS width FROM late JOIN l_returnflag_p USING (l_returnflag)""")
def automatic_vectors(spark, d):
    """ML-03, ML-04, ML-05, FN-11: stages chosen by column type: a boolean and a number, text indexed, few values indexed
    again in the vector, and the parts of a date left continuous: every slot of every row."""
    from pyspark.ml import Pipeline

    x = late_items(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_quantity") > 25).alias("is_big"), "l_quantity", "l_returnflag", F.to_date("o_orderdate").alias("ordered"), F.lit(0).alias("label"))
    x = stored(x, "items")
    used = x.drop("l_orderkey", "l_linenumber", "l_suppkey")
    made = Pipeline(stages=features.auto_stages(used, "label", by_name=False)).fit(x).transform(x)
    return slots(made, ["l_orderkey", "l_linenumber", "l_suppkey"], ["is_big", "quantity", "flag", "year", "month", "day", "weekday", "unix"])
